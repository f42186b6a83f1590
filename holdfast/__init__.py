"""Spark-native building, auditing and stress-testing of dataset splits."""
