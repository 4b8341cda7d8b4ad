"""Spark-first text analytics: cleaning, tokenizers, embeddings, translation metrics."""
