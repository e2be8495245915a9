"""Telemetry analytics on Spark: streaming."""
