"""sorrel: code knowledge graphs and corpus preparation as Spark DataFrames."""
