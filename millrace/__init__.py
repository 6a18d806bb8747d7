"""millrace: DataFrame-first operators for tables, streams and text corpora on Spark."""
