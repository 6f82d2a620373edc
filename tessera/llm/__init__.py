"""Training-data operators: mixing, filtering, deduplication, search and scoring of text corpora."""
