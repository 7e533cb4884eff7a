"""Operators for building training corpora; each module states how it treats nulls, ties and empty input."""
