"""PySpark-native analytics of source-code defects."""
