"""turnlake: Spark-native analytics over archived assistant conversations."""
