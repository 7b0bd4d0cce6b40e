"""Operators of the pairwise evaluation engine."""
