"""Three-valued compliance analytics on Spark."""
