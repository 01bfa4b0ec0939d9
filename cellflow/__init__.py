"""Spreadsheet-style analytics expressed as Spark DataFrame operations."""
