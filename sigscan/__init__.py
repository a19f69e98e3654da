"""sigscan: a PySpark engine for mining statistical reporting from text corpora."""
