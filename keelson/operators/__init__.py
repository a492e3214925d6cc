"""Relational operators over the states of collections. Each takes and returns DataFrames."""
