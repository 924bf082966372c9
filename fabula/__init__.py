"""Long-text analytics on Spark: splitting, search, statistics and upkeep of text tables."""

__version__ = "0.1.0"
