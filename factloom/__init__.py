"""Analytics over a corpus of files as Spark DataFrames."""
