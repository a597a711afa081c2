"""Operators for preparing training data; optional, imported by nothing in the core."""
