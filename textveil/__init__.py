"""PySpark-native detection, masking, restoring and scoring of personal identifiers."""
