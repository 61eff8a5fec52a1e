"""Training-data operators: scoring, filtering, dedup, sharding, tokenising."""
