"""Operators for preparing training text, and their queries.

Nothing else in the package imports this subpackage.
"""
