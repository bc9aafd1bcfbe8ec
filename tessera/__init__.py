"""Tessera: Spark-native analytics for dated, spatial and name-rich data."""
