"""Retrieval analytics on Spark: corpora, rankings, evaluation and corpus cleaning as DataFrame jobs."""
