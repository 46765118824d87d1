"""factloom: an evidence-memory and retrieval engine on Spark DataFrames."""

__version__ = "0.1.0"
