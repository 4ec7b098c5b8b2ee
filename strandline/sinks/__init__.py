"""Alignment formats: lines as DataFrames, published as single files."""
