"""Partitioned warehouse views, change detection, exports and catalogue queries on Spark."""
