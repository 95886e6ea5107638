"""Spark-native analytics over semi-structured financial documents and ledgers."""
