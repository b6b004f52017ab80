"""Music and audio analytics on Spark DataFrames."""
