"""Weighted-graph analytics for Spark: forests, components, edge classes and their statistics."""
