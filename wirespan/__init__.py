"""Spark-native analytics over coding-agent API traces."""
