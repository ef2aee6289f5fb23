"""Spark-native analytics for sparse 2D and 3D integer lattices."""

__version__ = "0.1.0"
