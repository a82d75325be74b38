"""Formulaic-language analytics on Spark DataFrames."""
