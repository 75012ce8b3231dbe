"""Behavioural-trace analytics as Spark DataFrame jobs."""
