"""Media library engine on Spark DataFrames."""
