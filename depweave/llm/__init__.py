"""Training-data operators: deduplication, decontamination, language ID, sharding, tokens."""
