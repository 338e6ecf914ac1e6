"""fathomline: semantic retrieval and retrieval analytics on Spark DataFrames."""
