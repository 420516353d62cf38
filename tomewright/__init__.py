"""Document knowledge analytics on Spark: ingestion, indexing, ranked retrieval, reporting."""
