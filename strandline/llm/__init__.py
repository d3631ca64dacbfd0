"""Operators of a training-data pipeline: filters, deduplication, scoring,
mixing, tokens and search over tables of documents, pages and vectors."""
