"""Operators for cleaning large text corpora.  Nothing outside this package imports it."""
