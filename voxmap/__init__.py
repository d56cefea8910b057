"""A Spark-native engine for volumetric maps from range-sensor point clouds."""
