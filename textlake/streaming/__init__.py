"""Continuous forms of the gated write and of the merge."""
