"""Called-pitch analytics as Spark DataFrame jobs."""
