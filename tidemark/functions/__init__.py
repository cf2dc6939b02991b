"""Expressions and metrics."""
