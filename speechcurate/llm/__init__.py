"""Operators for training-data pipelines: formatting, filters, models, mixing, duplicates, search."""
