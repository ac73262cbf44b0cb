"""A PySpark-native engine for personal-knowledge corpora."""
