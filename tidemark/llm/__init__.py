"""Training-data operators: ten corpus operators and the helpers they share.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
