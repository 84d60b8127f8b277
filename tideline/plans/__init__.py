"""The four study pipelines and the cross-study analysis."""
