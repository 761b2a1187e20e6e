"""Operators that prepare text corpora and large numeric columns for training."""
