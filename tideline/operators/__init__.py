"""Reusable DataFrame operators: temporal, candidate, ranking, metric and model fitting."""
