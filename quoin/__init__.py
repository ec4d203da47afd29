"""quoin: planar-geometry document analytics on Spark DataFrames."""
