"""Operators on source files and text for training data; nothing outside this package imports it."""
