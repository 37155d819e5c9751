"""Recommendation and ranking analytics as Spark DataFrame jobs."""
