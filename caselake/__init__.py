"""Analytics of event logs on Spark: logs, models and results are DataFrames."""
