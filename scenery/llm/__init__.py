"""Training-data operators: deduplication, scoring, filtering, extraction, mixing, sharding."""
