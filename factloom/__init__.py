"""factloom: a PySpark-native fact-graph analytics engine."""
