"""Lodestone: evidence-retrieval analytics on Spark DataFrames."""
