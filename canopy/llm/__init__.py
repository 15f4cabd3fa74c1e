"""Training-data operators: deduplication, filtering, packing, sharding and archives."""
