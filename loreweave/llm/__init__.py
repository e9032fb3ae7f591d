"""Training-data operators: ten deduplication, filtering, sharding and tokenizing stages.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
