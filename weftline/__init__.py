"""Spark-native analytics over typed property graphs and text."""
