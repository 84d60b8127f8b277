"""Temporal, relational prediction studies as Spark DataFrame plans."""
