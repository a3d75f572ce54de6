"""Spark-first engine for mining threaded discussion dumps."""
