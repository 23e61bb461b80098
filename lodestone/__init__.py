"""Spark-first document analytics: cleaning, structure, chunks, retrieval, lookup and evaluation as DataFrames."""
