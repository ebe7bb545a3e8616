"""Spark-native analytics for animated point-primitive ("splat") scenes."""
