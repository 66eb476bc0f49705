"""Training-data operators: quality, sharding, tokens, near copies, mixing, fingerprints, URLs, toxicity."""
