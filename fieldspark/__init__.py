"""fieldspark: field comparison and time-series analytics on Spark DataFrames."""
