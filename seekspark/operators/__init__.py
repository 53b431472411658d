"""Ranked search and index operators on DataFrames."""
