"""Training-data operators: scans, packing, de-duplication, search and formatting.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
