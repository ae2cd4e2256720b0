"""Sensor time series on Spark: every operator is a lazy function from DataFrame to DataFrame."""
