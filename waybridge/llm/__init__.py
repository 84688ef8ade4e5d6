"""Operators that prepare large text corpora for training, and the queries that apply them."""
