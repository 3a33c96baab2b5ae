"""Operators a training-data pipeline needs (documents, pages, embeddings)."""
