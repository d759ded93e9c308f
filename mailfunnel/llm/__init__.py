"""Operators for training-data pipelines: search, dedup, filtering, mixing, sharding, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
