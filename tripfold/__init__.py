"""Trips, repaired trips and visits from point-in-place readings, as Spark DataFrames."""
