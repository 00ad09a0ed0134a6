"""Training-data operators: filtering, deduplication, mixing, packing and formatting.

Nothing outside this folder imports it. ``register_all`` hands the queries and
their oracles to the entry module.
"""
