"""Operators for training-data pipelines: one module per problem, their queries in ``catalog``."""
