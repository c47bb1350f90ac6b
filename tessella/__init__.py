"""Tessella: Spark-native analytics over media catalogues."""
