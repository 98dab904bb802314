"""Operators that prepare text corpora for training."""
