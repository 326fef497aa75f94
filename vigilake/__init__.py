"""PySpark-native analytics over source code, captured web traffic and text corpora."""
