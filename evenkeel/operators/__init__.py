"""Operators on DataFrames: histograms, samplers, routing and metrics."""
