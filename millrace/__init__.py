"""Millrace: column lineage and relational operators as Spark DataFrame jobs."""
