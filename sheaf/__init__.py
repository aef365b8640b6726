"""sheaf: a PySpark-native engine for research-output record linkage, clean-up and ranking."""

__version__ = "0.1.0"
