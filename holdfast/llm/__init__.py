"""Operators for preparing training text: filters, deduplication, mixing, tokens and search."""
