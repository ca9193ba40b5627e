"""Spark-native analytics over evidence logs, hypergraphs and bitemporal documents."""
