"""Sorrel: review analytics, hybrid retrieval and ordinal sentiment scoring on Spark DataFrames."""
