"""Training-data operators: scoring, scanning, deduplication, packing.

Nothing outside this subpackage imports it.
"""
