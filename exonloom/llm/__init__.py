"""Operators for preparing training text: duplicates, search, scoring, filters, archives."""
