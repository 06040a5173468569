"""Spark-first engine for document corpora, retrieval experiments and their evaluation."""
