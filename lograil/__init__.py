"""Spark jobs over web access logs: parsing, detection, archives, features, retrieval."""
