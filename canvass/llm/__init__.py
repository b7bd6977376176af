"""Operators for large training-data pipelines (self-contained; nothing else in the library imports it)."""
