"""Structured-document transformations on Spark."""
