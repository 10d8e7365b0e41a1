"""Training-data operators: scoring, deduplication, search, mixing, tokens and archives."""
