"""Operators that prepare text for training language models.

Self-contained: nothing outside this package imports it."""
