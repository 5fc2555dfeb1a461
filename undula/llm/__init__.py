"""Training-data operators: formatting, filtering, counting, deduplication, search and mixing."""
