"""accessio: record linkage and data processing on Spark DataFrames."""
