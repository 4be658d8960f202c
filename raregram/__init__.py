"""Text search and corpus statistics on variable-length rare grams, for Spark."""
