"""Training-data operators: search, token counts, quality, media, dedup, packing, output, joins, LM scores.

Nothing outside this folder (but for ``corpus_pipeline.py``) imports it.
"""
