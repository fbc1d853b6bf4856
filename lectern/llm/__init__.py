"""Operators for training data on text; nothing outside this subpackage imports it."""
