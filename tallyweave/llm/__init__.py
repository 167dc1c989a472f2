"""Training-data operators: deduplication, filtering, scanning, sharding and packing."""
