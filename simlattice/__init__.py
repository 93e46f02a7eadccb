"""Spark-first similarity, lineage and ranking analytics for collections of text records."""

__version__ = "0.1.0"
