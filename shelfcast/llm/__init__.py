"""Operators for preparing training text: deduplication, extraction, tokenising, packing, scoring."""
