"""A Spark-native engine for linear inverse problems and tomographic reconstruction."""
