"""Spark-native engine for piecewise-constant data on real-valued axes."""
