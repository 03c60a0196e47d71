"""Light-curve analytics on Spark DataFrames."""
