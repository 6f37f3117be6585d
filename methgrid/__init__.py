"""Methylation-interval analytics expressed as Spark DataFrame operations."""
