"""Training-data operators: mixing, sharding, quality, deduplication, packing, PII, token files, secrets, search.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL twins.
"""
