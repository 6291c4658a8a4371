"""Training-data operators: scoring, deduplication, extraction, sharding, encoding.

Nothing else in the library imports this subpackage.
"""
