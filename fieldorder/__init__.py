"""fieldorder: contest, ranking and probability analytics on Spark DataFrames."""
