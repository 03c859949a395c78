"""A full-text search and text-analytics engine on Spark DataFrames."""
