"""Training-data operators: sanitising, deduplication, search, packing, mixing, sharding, scoring."""
