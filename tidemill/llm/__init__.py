"""Operators for preparing text corpora and their statistics; nothing outside this package imports it."""
