"""Antigenic cartography, sequences and trees on Spark DataFrames."""
