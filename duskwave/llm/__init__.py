"""Training-data operators: language id, dedup, decontamination, extraction, archives, mixing, sharding."""
