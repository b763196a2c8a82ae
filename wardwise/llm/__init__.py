"""Training-data operators: text cleaning, deduplication, search and formatting."""
