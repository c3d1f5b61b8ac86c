"""Structured Streaming operators and their batch twins."""
