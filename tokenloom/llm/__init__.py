"""Training-data operators: deduplication, filtering, scoring, formatting and packing."""
