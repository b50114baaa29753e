"""linkloom: link-graph analytics over web feeds, on Spark DataFrames."""
