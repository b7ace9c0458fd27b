"""Lepidus: Spark-native analytics over annotated specimens, their measurements and their descriptions."""
