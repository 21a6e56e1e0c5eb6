"""Operators for preparing training text: joins, formatting, search, sharding, scans, tokens.

Nothing else in the library imports this subpackage.
"""
