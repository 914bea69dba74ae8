"""Planar-drawing analytics as Spark DataFrames: many drawings at once, keyed by ``drawing_id``."""
