"""Training-data operators: sharding, scanning, tokenising, deduplication and filtering of text corpora.

Nothing outside this subpackage imports it.
"""
