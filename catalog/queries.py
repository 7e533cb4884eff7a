"""Imports every module that registers queries."""

from catalog import aggregates, columns, joins, sources, streams  # noqa: F401
