"""PySpark-native engine for scoring and monitoring multiple-choice bias evaluations."""
