"""Column functions: every helper takes columns and returns a native expression."""
