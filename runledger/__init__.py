"""runledger: the history of benchmark runs, kept and queried on Spark."""

__version__ = "0.1.0"
