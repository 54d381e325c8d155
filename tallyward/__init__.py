"""Behavioural-risk analytics on Spark DataFrames."""
