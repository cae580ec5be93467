"""Operators for preparing training text: filters, duplicates, pseudonyms, shards, tokens.

Nothing else in the library imports this subpackage.
"""
