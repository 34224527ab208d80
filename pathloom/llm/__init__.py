"""Training-data operators: search, cleaning, deduplication, tokenisation and packing.

Nothing outside this subpackage imports it.
"""
