"""Bulk comparison of structured document versions as Spark DataFrame jobs."""
