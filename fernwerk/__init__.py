"""Habitat-suitability analytics on Spark."""
