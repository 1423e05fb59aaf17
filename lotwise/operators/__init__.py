"""Operators on DataFrames: joins, ranking, grouping, linkage, graphs, pricing and changes."""
