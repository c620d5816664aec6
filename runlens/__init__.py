"""runlens: Spark-native analytics for automated-test execution data."""

__version__ = "0.1.0"
