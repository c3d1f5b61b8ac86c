"""Readers, writers and the canonical tables over the driver tables."""
