"""A Spark-native entity store and ranked entity search."""
