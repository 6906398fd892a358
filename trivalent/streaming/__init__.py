"""Streaming of the three-valued analytics."""
