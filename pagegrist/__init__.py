"""Spark-native quality, URL, feed and retrieval-log analytics over landed web documents."""
