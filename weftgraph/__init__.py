"""weftgraph: a Spark-native engine that turns corpora and tables into a typed, cited property graph."""

__version__ = "0.1.0"
