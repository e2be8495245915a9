"""Telemetry analytics on Spark: operators."""
