"""Spark-native static file triage, rule mining, model evaluation and drift analytics."""
