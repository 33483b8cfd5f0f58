"""Operators for large text corpora: one module per operator, their queries in ``queries``."""
