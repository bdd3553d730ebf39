"""Training-data operators: tokenizing, filtering, deduplication and packing.

Nothing outside this package imports it; `__spark_entry__` adds its queries
only where the package is present.
"""
