"""loomline: comparative sequence analytics on PySpark DataFrames."""
