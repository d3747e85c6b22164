"""Quantitative image analytics as Spark DataFrame operators."""
