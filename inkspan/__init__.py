"""Spark-native analytics over document stores and over tables seen as records."""
