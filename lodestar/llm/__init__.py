"""Training-data operators: formatting, scanning, deduplication, mixing and packing.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
