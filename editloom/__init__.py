"""Bulk genome-edit design, guide analytics and review as Spark DataFrame jobs."""
