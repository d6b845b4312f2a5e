"""Page-level work over document collections, planned as Spark DataFrames."""
