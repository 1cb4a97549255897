"""Operators for preparing training data; their queries are in ``catalog``."""
