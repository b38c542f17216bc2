"""Predicates that Spark SQL has no single form for."""
