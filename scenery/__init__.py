"""Spark-first analytics over annotated 3D scenes, question batches and their corpora."""
