"""loomgraph: a PySpark-native engine for code graphs and grounded retrieval."""
