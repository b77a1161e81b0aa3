"""Learned, lossless compressed columns and star-schema analytics on Spark DataFrames."""
