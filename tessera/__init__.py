"""Spark-first analytics for multi-cohort tissue imaging and training-data preparation."""
