"""Profiling, constraints, transforms and lossless codecs for numeric series, on Spark."""
