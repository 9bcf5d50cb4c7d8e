"""wireloom: network and event telemetry analytics written as Spark DataFrame jobs."""
