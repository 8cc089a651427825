"""Training-data operators: dedup, scoring, mixing, search, tokens, privacy, packing."""
