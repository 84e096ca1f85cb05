"""bagweave: token-bag analytics and corpus preparation on Spark DataFrames."""
