"""Training-data operators: deduplication, filtering, packing, sharding, tokenising.

Nothing else in the package imports this subpackage.
"""
