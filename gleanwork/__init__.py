"""Decision-data curation and evaluation on Spark."""

__version__ = "0.1.0"
