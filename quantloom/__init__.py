"""Market-data and portfolio analytics expressed as plain Spark DataFrames."""
