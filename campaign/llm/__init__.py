"""Operators for training-data text. Nothing else in the library imports this subpackage."""
