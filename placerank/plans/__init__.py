"""Composite indices and the registered query catalogue."""
