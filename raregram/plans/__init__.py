"""Access path choice, and the catalog of queries with their SQL."""
