"""Operators for training-data pipelines on texts and names; nothing else in the library imports this package."""
