"""Operators bound to the given tables: each module holds ``QUERIES`` and ``ORACLES``."""
