"""Training-data operators: packing, deduplication, scoring and filters over a documents table."""
