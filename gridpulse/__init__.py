"""Telemetry analytics on Spark: decode, upsert, aggregate, roll up and predict."""
