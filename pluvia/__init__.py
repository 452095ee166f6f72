"""pluvia: a Spark-native analytics engine for storm-associated rainfall extremes."""
