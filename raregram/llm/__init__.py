"""Training-data operators: language id, deduplication, quality, packing, search, scans.

Nothing else in the library imports this subpackage.
"""
