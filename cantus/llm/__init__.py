"""Training-data operators: deduplication, scoring, filtering, packing, chat collapse.

Nothing else in the library imports this subpackage.
"""
