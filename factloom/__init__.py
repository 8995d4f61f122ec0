"""Spark-native analytics over entity, reference, edge and text tables."""
