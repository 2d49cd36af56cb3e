"""A permission-aware knowledge retrieval engine written for Spark: tables in, DataFrames out."""
