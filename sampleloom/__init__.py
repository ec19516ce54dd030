"""PySpark-native engine for sample datasets and tensors stored as rows."""
