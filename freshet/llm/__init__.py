"""Operators for model-training data. Optional: nothing outside this subpackage imports it."""
