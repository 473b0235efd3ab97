"""Operators: DataFrames in, one lazily evaluated DataFrame out; no collect."""
