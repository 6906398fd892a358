"""Queries of the catalogue, by subject."""
