"""A retrieval and corpus-processing engine written with Spark DataFrames."""

__version__ = "0.1.0"
