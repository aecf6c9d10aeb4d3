"""Spark-native analytics over procurement records, bid documents and event logs."""
