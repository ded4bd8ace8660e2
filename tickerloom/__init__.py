"""Equity-research analytics as Spark DataFrame plans and streaming jobs."""
