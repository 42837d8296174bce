"""Spark-native detection, masking, restoring and auditing of sensitive values in large text data."""
