"""Worksheet functions as column expressions, by name in ``core.FUNCTIONS``."""
