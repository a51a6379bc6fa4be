"""Operators for large training corpora: tokens, quality, search, duplicates, packing."""
