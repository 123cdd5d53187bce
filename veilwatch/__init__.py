"""Agent activity audit and data protection as Spark jobs."""
