"""Operators that prepare training text: language, copies, personal data, pages, mixing and shards."""
