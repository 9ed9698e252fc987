"""quillon: Spark-native analytics over ordered, nested event data and text corpora."""
