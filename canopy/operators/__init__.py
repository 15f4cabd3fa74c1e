"""Operators: DataFrame in, DataFrame out; column names are arguments."""
