"""Spark-native analytics over news items: feeds to daily, auditable tables."""
