"""Training-data operators: deduplication, filtering, extraction, search, mixing, sharding and packing."""
