"""Training-data operators: near-dedup, quality, packing, PII and the rest.

Nothing outside this subpackage imports it.
"""
