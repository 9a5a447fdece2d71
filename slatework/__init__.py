"""Deck analytics expressed as Spark DataFrame operators."""
