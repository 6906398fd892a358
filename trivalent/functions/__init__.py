"""Functions of the three-valued analytics."""
