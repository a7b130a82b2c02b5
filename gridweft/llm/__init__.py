"""Operators for preparing training text: cleaning, deduplication, scoring, tokenising and formatting."""
