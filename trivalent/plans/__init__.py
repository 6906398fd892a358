"""Plans of the three-valued analytics."""
