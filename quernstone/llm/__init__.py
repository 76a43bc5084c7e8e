"""Training-data operators: extraction, deduplication, filtering, mixing and packing."""
