"""evidara: context-conditioned evidence graphs on Spark DataFrames."""

__version__ = "0.1.0"
