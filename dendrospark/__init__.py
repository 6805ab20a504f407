"""Spark-native agglomerative hierarchical clustering and internal cluster validation."""
