"""assayflow: a Spark-native engine for literature-extraction analytics."""

__version__ = "0.1.0"
