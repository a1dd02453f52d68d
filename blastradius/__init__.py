"""Column-lineage impact analytics as Spark DataFrame jobs."""
