"""readloom: a Spark-native analytics engine for aligned sequencing reads."""

__version__ = "0.1.0"
