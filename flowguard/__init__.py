"""flowguard: network-telemetry analytics as Spark jobs."""
