"""Spark-native analytics for streaming-media manifests and the data around them."""
