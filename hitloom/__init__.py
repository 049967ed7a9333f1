"""A Spark-native web-analytics engine: hits to sessions to one wide row per event."""
