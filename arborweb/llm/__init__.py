"""Operators for preparing training data: scoring, filtering, near-dedup, mixing, encoding.

Nothing outside this subpackage imports it, so the folder can be removed
without touching the rest of the library.
"""
