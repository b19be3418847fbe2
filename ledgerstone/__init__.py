"""Catalog analytics on Spark."""
