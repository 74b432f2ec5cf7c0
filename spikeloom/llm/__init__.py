"""Operators for training data on records and texts. Nothing outside this package imports it."""
