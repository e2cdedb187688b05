"""Fleet telemetry analytics on Spark: every operator is a function of DataFrames."""
