"""siftline: Spark-native security-findings analytics."""
