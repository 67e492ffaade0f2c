"""framelake: time-first sensor recordings as Spark DataFrames."""
