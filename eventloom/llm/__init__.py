"""Operators for large-scale training-data pipelines (text corpora and embeddings)."""
