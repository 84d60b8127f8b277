"""Scalar expressions and ordered-scan helpers."""
