"""A text-analytics engine on PySpark DataFrames."""
