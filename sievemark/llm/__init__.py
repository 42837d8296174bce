"""Operators for building training corpora: sharding, token counts, deduplication, scoring, packing.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
