"""Sources of the three-valued analytics."""
