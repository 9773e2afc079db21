"""Training-data operators: archives, extraction, filtering, deduplication, packing, sharding."""
