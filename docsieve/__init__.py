"""docsieve: a PySpark-native engine for finding and reviewing evidence in documents."""
