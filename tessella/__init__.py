"""Spark-native analytics over document and knowledge data: every operator takes DataFrames and returns a lazy DataFrame."""
