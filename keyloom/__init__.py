"""Relational schema intelligence on Spark: the catalog as DataFrames, evidence measured by Spark jobs."""

__version__ = "0.1.0"
