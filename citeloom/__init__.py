"""Citeloom: a PySpark-native analytics engine for literature graphs and recommendation."""
