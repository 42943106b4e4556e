"""tidemark: ordered, partitioned message streams on Spark."""

__version__ = "0.1.0"
