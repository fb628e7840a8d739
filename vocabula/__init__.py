"""Vocabulary analytics on Spark: glossaries, code concepts, work items and documents as DataFrames."""

__version__ = "0.1.0"
