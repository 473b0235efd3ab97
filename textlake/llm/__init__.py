"""Operators of a pipeline for training data, with their queries in ``queries``."""
