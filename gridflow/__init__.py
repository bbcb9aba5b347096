"""Turning irregular sheets and ordinary tables into validated, versioned datasets, as Spark DataFrames."""
