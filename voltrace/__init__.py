"""Spark-native regional pressure analytics over provenance-tracked time series."""
