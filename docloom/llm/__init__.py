"""Training-data operators: deduplication, packing, scoring, extraction, archives and mixing.

Nothing else in the library imports this subpackage. Each operator is one module with a
general interface; ``queries`` holds the thin contract queries built on them.
"""
