"""sparrowdex: full-text retrieval, ranking and corpus processing on Spark DataFrames."""
