"""Operators over the position table; each takes and returns DataFrames."""
