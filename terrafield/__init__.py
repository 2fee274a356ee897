"""Terrafield: Bayesian geostatistics on Spark DataFrames."""
