"""Weighted automata over semirings as Spark DataFrames."""
