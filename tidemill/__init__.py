"""tidemill: ordered-series analytics on Spark DataFrames."""
