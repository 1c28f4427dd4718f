"""matchlake: match analytics and corpus preparation on Spark DataFrames."""
