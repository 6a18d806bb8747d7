"""Relational operators: each takes DataFrames and returns one, and runs nothing itself."""
