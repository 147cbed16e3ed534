"""Scalar expressions: built-in Spark functions only, no Python UDFs."""
