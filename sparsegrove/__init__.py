"""Sparse and dense retrieval, keyphrases, citations and training data on Spark DataFrames."""
