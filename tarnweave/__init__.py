"""Tarnweave: a PySpark-native analytics engine for web-tracking measurement data."""
