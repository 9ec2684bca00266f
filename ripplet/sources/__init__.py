"""Readers of the text that tools write, as DataFrames, and the sinks that mirror them."""
