"""Second-hand market analytics expressed as Spark DataFrame jobs."""
