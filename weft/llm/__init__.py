"""Operators for large text corpora: search, mixing, de-duplication, classifiers, archives, language models, tokens.

Every operator is a function from DataFrames to DataFrames. Nothing outside this package imports it.
"""
