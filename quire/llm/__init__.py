"""Training-data operators: formatting, filtering, deduplication, mixing, tokens, search.

Nothing else in the library imports this subpackage.
"""
