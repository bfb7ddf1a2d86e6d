"""Operators for large text corpora: search, deduplication, mixing, personal data, classifiers, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
