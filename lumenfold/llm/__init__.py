"""Training-data operators: deduplication, mixing, filtering, scoring, formatting, tokenizing.

Nothing outside this subpackage imports it.
"""
