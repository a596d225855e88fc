"""Operators for preparing training text and code; nothing outside this package imports it."""
