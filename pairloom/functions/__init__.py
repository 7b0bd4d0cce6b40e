"""Scalar expressions, all built from Spark functions unless a docstring says why not."""
