"""Column functions of the telemetry domain."""
