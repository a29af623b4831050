"""Place ranking, evidence fusion and corpus preparation on Spark DataFrames."""
