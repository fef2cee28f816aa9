"""Training-data operators: language ID, packing, mixing, deduplication, quality, toxicity."""
