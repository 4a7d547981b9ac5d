"""Archive analytics on Spark: snapshot ingestion, as-of reads, text search, and corpus preparation."""
