"""Spark DataFrame operators for device pings, alerts and event studies."""
