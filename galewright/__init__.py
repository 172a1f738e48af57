"""Galewright: a Spark-native engine for sensor series, network-search tables and corpus checks."""
