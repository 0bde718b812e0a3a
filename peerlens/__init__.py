"""Spark-native analytics over corporate disclosures: sources, text, vectors, peers, evaluation."""

__version__ = "0.1.0"
