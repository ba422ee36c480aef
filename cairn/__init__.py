"""cairn: evidence retrieval and evaluation as Spark jobs over DataFrames."""
