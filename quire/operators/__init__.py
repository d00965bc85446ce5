"""Operators on DataFrames: catalogue, lines and metrics, slicing, notes, matching, lint, page layout."""
