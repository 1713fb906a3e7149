"""Spark-native analytics for recovering and scoring the order of shuffled items."""
