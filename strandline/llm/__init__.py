"""Operators of a training-data pipeline over web pages, documents and embeddings."""
