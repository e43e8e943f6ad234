"""Operators on DataFrames: weighted relations, joins, graphs, sequences."""
