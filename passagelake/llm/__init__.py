"""Operators that prepare training text: scoring, filtering, deduplication, decontamination and packing."""
