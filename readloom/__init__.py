"""Spark-native analytics over aligned sequencing reads."""
