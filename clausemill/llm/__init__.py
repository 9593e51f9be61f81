"""Training-data operators: dedup, language, quality, secrets, tokens, packing and search."""
