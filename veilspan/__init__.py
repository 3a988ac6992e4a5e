"""A PySpark-native engine for finding, judging and replacing personal data in text corpora."""
