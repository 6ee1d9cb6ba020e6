"""Chunkmere: a Spark-native analytics engine for deduplicating, versioned file snapshots."""

__version__ = "0.1.0"
