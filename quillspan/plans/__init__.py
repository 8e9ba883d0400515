"""Catalogue of named queries over the driver's tables."""
