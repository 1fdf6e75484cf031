"""Tidewell: Spark-native operators for sparse, noisy time series and experiment records."""
