"""Training-data operators: deduplication, scanning, sampling, search, scoring and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
