"""Relational operators of the literature pipeline."""
