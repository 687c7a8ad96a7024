"""Log ingestion and similarity search as plain functions over Spark DataFrames."""
