"""Lattica: semantic-model analytics on DataFrames."""
