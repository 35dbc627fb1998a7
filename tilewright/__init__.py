"""tilewright: a Spark-native engine for chunked N-dimensional array containers."""
