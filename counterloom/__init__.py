"""Counter-log analytics as Spark DataFrame jobs."""
