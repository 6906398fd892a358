"""Operators of the three-valued analytics."""
