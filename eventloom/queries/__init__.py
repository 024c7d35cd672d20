"""Registered queries: each applies an operator to telemetry shapes of the given tables."""
