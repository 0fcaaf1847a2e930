"""Docketry: a Spark-first evidence-analytics engine."""
