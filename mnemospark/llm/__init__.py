"""Training-data operators: mixing, deduplication, scoring, filtering, search, packing, counting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
