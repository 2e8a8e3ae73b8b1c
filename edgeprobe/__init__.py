"""edgeprobe: a Spark-native engine for falsifying trading hypotheses on bar data."""
