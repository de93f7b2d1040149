"""Training-data operators: mixing, quality, language, tokens, deduplication, sharding, chat."""
