"""Spark-native analytics over property graphs of reports and over text corpora."""
