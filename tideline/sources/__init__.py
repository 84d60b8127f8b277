"""Readers, validators, sinks and the bindings to the driver tables."""
