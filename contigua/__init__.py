"""Contiguity-constrained clustering and data preparation on Spark DataFrames."""
