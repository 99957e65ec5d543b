"""Operators for preparing training data, and their named queries."""
