"""Spindrift: recommendation, discovery and experiment analytics on Spark DataFrames."""

__version__ = "0.1.0"
