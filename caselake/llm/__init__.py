"""Operators for preparing training text: extraction, de-duplication, tokens, media, secrets, search, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
