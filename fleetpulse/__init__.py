"""Telemetry-health analytics on PySpark DataFrames and Structured Streaming."""
