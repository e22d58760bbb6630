"""Palimpsest: versioned key-value, property-graph and model queries on PySpark."""
