"""Readers: text parsers, table store and reference tables."""
