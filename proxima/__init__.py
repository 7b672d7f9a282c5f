"""Exact nearest-neighbour analytics over large 3-D point sets, on PySpark."""
