"""Spark-first engine for dirty order feeds, their aggregates and the data work around them."""
