"""Operators for preparing training data: filtering, deduplication, tokenizing, packing and archives."""
