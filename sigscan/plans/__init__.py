"""Whole queries over the driver's tables."""
