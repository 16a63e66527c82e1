"""Training-data operators: search, filtering, deduplication, mixing and tokenising.

Nothing outside this subpackage imports it; `queries.py` holds the registered
queries and their oracle SQL.
"""
