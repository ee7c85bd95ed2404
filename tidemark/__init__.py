"""Spark-native interval-timeline analytics."""
