"""Operators that prepare training data from document corpora."""
