"""Spark-native record linkage: normalise, block, retrieve, compare, decide, validate."""
