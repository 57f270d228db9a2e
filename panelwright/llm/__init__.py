"""Operators over text corpora, conversations and embeddings, for the preparation of training data."""
