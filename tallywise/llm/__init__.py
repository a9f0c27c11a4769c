"""Training-data operators: deduplication, language models, classification, formatting and packing.

Nothing outside this folder imports it. Each operator module has its own general interface;
``queries`` holds the thin registered queries and their SQL.
"""
