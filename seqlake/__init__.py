"""Analytics on append-only event archives, as Spark DataFrames."""
