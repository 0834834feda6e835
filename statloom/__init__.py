"""Financial-statement analytics as Spark DataFrame jobs."""
