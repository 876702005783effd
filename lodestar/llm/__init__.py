"""Operators for preparing training text: quality, deduplication, sanitising, mixing, search, packing, fingerprints, sharding, archives.

Nothing outside this folder imports it.
"""
