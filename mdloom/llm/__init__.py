"""Operators for large training-text tables; nothing outside this package imports it."""
