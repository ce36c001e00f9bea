"""Training-data operators: scoring, deduplication, filtering, mixing, encoding, sharding, search."""
