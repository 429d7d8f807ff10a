"""Spark-native analytics over structured business-reporting filings."""
