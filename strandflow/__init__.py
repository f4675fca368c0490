"""Spark-native transcript quantification and repeat-element analytics."""
