"""Text-similarity analytics on Spark DataFrames."""
