"""Tributary: merging and auditing document collections with Spark DataFrames."""
