"""Operators for preparing training text: filtering, deduplication, search, packing and archives."""
