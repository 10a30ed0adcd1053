"""Readers that end in DataFrames."""
