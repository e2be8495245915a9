"""Telemetry analytics on Spark: sources."""
