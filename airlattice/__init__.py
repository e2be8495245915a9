"""Spark-first analytics for high-rate sensor telemetry, and training-data operators in ``llm``."""
