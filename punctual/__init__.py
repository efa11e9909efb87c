"""Transit punctuality analytics on PySpark DataFrames."""
