"""Larkspur: a PySpark-native catalog, workflow and image analytics engine."""
