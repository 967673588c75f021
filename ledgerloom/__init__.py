"""Spend and contract analytics on Spark DataFrames."""
