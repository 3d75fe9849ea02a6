"""Training-data operators: mixing, sharding, searches, negatives, quality, toxicity, packing, scoring, PII, near-dedup."""
