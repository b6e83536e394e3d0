"""docprep: long-document preparation on Spark, one corpus at a time."""
