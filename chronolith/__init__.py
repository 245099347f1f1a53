"""Time-series analytics on Spark: a metric query language lowered to DataFrames, a sample store, ingest and result shaping."""
