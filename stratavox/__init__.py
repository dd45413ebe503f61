"""stratavox: a Spark-native engine for adaptive semantic 2.5D grids."""
