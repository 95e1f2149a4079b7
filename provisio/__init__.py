"""Provisio: regulatory-text analytics as Spark DataFrame operators."""
