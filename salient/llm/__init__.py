"""Operators for preparing training text at scale, one module per operator.

Every operator takes and returns DataFrames.  Nothing outside this folder and
``corpus_pipeline.py`` imports it.
"""
