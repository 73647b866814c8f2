"""Training-data operators: sharding, fingerprints, deduplication, filters, tokenizing.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
