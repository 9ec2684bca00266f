"""ripplet: change-impact analytics over software history as Spark DataFrames."""

__version__ = "0.1.0"
