"""A Spark-native engine for property graphs, revisioned notes, event logs and reports."""
