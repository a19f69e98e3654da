"""Incremental processing with persisted state."""
