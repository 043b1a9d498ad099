"""Operators for training-data pipelines: one module per operator, each with a general interface and a thin query."""
