"""Strandline: pairwise sequence-alignment analytics on Spark DataFrames."""
