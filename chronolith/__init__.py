"""Bitemporal, provenance-first memory analytics on Spark DataFrames."""
