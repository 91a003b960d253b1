"""Spark-native analytics over case files: text blocks, entities, graphs, timelines and corpora."""

__version__ = "0.1.0"
