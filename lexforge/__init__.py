"""Legal-text analytics on Spark DataFrames."""
