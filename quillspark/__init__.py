"""Style, keyword, topic and classification analytics over short-text corpora, on Spark."""

__version__ = "0.1.0"
