"""kiln: Spark-native feature, sampling, training, scoring and evaluation jobs."""

__version__ = "0.1.0"
