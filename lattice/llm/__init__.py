"""Training-data operators: cleaning, deduplication, scoring, packing and formatting of text corpora."""
