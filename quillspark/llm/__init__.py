"""Operators that prepare training corpora: duplicates, personal data, tokens, search, packing."""
