"""Relational operators of the worksheet language as DataFrame transformations."""
