"""Operators for training data: near duplicates, broken pairs, encoding, leakage and shared spans."""
