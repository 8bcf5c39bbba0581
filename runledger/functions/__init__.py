"""Scalar expressions: ``Column -> Column``, all built from Spark's own functions."""
