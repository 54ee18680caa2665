"""Skarn: a PySpark-native engine for image-collection pipelines, vector clustering and exploratory aggregates."""
