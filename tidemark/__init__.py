"""Spark-native analytics over event logs: ingestion, contracts, roll-ups, serving, drift and evaluation."""
