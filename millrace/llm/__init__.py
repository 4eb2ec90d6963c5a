"""Operators for preparing training data: linking, deduplication, cleaning, tokenising, mixing and labelling."""
