"""plumbline: Spark-native analytics for building, auditing and scoring labelled text-evaluation datasets."""

__version__ = "0.1.0"
