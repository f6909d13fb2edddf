"""laurel: candidate ranking and evidence analytics on Spark DataFrames."""
