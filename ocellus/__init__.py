"""Image, disparity, point-cloud and graph analytics on Spark DataFrames."""
