"""Telemetry analytics on Spark: plans."""
