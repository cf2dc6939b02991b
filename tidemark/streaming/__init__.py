"""The same rules over unbounded input."""
