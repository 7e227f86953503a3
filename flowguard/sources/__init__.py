"""Readers of sensor files, routing of their outcomes, and sinks."""
