"""Readers and writers of the literature pipeline."""
