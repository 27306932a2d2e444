"""Precedent retrieval and record processing on Spark DataFrames."""
