"""Operators for preparing large training data. Nothing outside this package imports it."""
