"""Training-data operators: packing, scoring, filtering, deduplication, search, extraction, mixing.

Nothing outside this subpackage imports it.
"""
