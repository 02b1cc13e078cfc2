"""Training-data operators: quality, deduplication, tokens, archives, URLs, chat."""
