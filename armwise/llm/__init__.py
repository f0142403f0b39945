"""Training-data operators: deduplication, filtering, scoring, mixing and encoding of text corpora."""
