"""Operators for preparing training data: filters, scans, deduplication, tokenizing and packing."""
