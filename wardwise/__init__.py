"""Neighbourhood analytics on Spark DataFrames."""
