"""Telemetry alarm analytics on Spark: samples, rules, alarm lifecycle, read models."""
