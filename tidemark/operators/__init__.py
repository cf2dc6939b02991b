"""Relational and point-in-time operators."""
