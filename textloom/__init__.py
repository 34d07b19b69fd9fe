"""Lexical fingerprinting, navigable text memory and corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"
