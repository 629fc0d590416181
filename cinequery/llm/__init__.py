"""Training-data operators: sharding, deduplication, tokenising, filtering and search."""
