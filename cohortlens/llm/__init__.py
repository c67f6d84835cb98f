"""Operators for preparing training text: deduplication, language, quality, secrets, contamination, counting, packing."""
