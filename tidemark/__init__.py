"""Telemetry and corpus analytics on Spark DataFrames."""
