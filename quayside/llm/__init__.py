"""Operators that prepare text for training: rules, scores, fingerprints, joins, extraction, mixing, tokens.

Every operator takes and returns DataFrames, reads only the columns it names,
and gives null or empty texts a result of their own. Nothing outside this
folder imports it, but for the entry module and ``corpus_pipeline.py``.
"""
