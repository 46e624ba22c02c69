"""Training-data operators: dedup, language ID, BPE, mixing, sharding, filters."""
