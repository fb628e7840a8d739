"""Operators for training data: canonical duplicates, co-occurrence, frequencies, value mapping, packing, leaks and keyword spam."""
