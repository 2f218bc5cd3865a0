"""gaugeworks: a PySpark-native engine for scoring text produced by language models."""
