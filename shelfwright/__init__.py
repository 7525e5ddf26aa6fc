"""Product-catalogue quality engine on Spark DataFrames."""
