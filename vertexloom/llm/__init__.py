"""Training-data operators: chat formatting, language-model scores, near-duplicate joins, toxicity,
decontamination, licence scans, embedding dedup, token shards, substring dedup and byte-level BPE.

Nothing outside this subpackage imports it. ``queries.py`` registers the queries and their SQL.
"""
