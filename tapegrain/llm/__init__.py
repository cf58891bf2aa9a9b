"""Operators for training data; nothing else in the package imports them."""
