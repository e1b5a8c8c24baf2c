"""Structured Streaming forms of the telemetry and ingestion operators."""
