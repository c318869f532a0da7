"""Structured Streaming form of the periodic run."""
