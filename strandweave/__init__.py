"""Connection discovery over text corpora on Spark DataFrames."""
