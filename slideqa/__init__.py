"""Data work around slide-level visual question answering, as functions from DataFrames to DataFrames."""
