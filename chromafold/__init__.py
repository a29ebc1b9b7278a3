"""chromafold: Spark-native compression and analysis of sparse, high-cardinality features."""

__version__ = "0.1.0"
