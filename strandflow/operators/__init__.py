"""Relational, graph and numeric operators on DataFrames."""
