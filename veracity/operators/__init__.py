"""Relational operators of the scoring pipeline (DataFrame in, DataFrame out)."""
