"""Spark-native project intelligence: parsing, gating, deduplicating and serving project records."""
