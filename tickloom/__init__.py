"""Spark-native analytics for market time series and corpus preparation."""
