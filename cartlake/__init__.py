"""Commerce analytics on Spark: sources, operators, plans and streaming jobs over DataFrames."""
