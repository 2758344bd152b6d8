"""Scalar building blocks: text of values, casts, natural text order."""
