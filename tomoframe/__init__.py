"""Spark-native particle tables, volumes and the data work around them."""
