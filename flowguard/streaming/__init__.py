"""Structured Streaming forms of ingestion, rules, alerts and features."""
