"""cairn: Spark-native analytics over governed text records and typed claims."""

__version__ = "0.1.0"
