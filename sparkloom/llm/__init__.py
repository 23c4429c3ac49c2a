"""Training-data operators: cleaning, archives, deduplication, sharding, tokens and privacy."""
