"""loreweave: curated text knowledge and agent activity analytics on Spark DataFrames."""
