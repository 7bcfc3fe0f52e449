"""Column profiling, preprocessing recommendation and fitted transforms on Spark DataFrames."""

__version__ = "0.1.0"
