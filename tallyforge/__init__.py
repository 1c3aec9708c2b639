"""Prediction tables and label sets as Spark DataFrames."""
