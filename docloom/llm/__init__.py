"""Operators for preparing training text: deduplication, language, tokens, packing, quality and mixing."""
