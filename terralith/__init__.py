"""Spark-native engine for map-derived building and infrastructure tables."""
