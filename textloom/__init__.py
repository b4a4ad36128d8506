"""textloom: a Spark-native engine that audits, splits, retrieves over and prepares text corpora."""

__version__ = "0.1.0"
