"""rulemill: a PySpark-native analytics engine for rule documents, nested records and text corpora."""

__version__ = "0.1.0"
