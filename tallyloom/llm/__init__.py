"""Operators for preparing training text: filters, near-duplicate search, extraction, encoding."""
