"""Operators: the matching kernel and its use on DataFrames."""
