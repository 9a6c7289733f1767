"""Corpus preparation and language-model evaluation analytics on Spark DataFrames."""
