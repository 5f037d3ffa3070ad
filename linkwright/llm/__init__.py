"""Training-data operators: redaction, deduplication, token output, scoring and packing.

Nothing else in the library imports this subpackage.
"""
