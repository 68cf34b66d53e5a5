"""Retrieval analytics on DataFrames."""
