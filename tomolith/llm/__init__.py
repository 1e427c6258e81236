"""Training-data operators: dedup, filters, extraction, formatting, packing.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
