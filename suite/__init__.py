"""Queries over the given tables, each with an SQL text that gives the same rows."""
