"""Composed queries over the driver's tables."""
