"""Operators for training data: cutoffs, encoding, mixing, languages. Nothing outside this package imports it."""
