"""Document revision analytics on Spark DataFrames."""
