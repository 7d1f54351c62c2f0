"""Spark-native analytics over crawled web sites and text collections."""
