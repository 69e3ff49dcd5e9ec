"""folioscale: a Spark-native document knowledge, retrieval and release engine."""

__version__ = "0.1.0"
