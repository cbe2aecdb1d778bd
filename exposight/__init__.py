"""Exposure and sharing analytics on Spark."""
