"""Document-to-KPI analytics as Spark DataFrame operators."""
