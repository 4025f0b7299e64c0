"""PySpark-native retrieval, record-linkage and proposal engine for engineering documents."""
