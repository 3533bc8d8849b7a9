"""Retail star schema, data marts and reports as Spark DataFrame jobs."""
