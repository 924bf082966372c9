"""Relational, graph, vector and model-backed operators on DataFrames."""
