"""Labelled-window analytics on Spark DataFrames."""
