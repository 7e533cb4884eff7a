"""Registered queries: each one runs an operator over views of the given tables, beside its SQL check."""
