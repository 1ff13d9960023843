"""A store for ordered, immutable facts, kept as columnar files and read as DataFrames."""
