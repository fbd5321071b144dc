"""chronoframe: a Spark-native bitemporal analytics library."""
