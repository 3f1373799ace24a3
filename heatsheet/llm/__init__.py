"""Operators that prepare training text: mixing, language, duplicates, quality, pages, tokens, search.

Nothing else in the library imports this package.
"""
