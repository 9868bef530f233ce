"""lumatrace: Spark-native duplicate detection and similarity search over visual assets."""

__version__ = "0.1.0"
