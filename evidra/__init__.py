"""Evidence ranking and corpus preparation on Spark DataFrames."""
