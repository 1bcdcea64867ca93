"""PySpark-native analysis of text and code corpora."""
