"""Readers, writers and verified tables."""
