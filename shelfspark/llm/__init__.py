"""Operators for training data. Nothing outside this subpackage and its tests imports it."""
