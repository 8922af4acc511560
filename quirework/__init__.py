"""quirework: Spark-native analytics over long documents and training corpora."""
