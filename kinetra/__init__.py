"""Spark jobs over large collections of motion series."""
