"""Operators for a training-data pipeline over the tables documents, embeddings and labels.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
