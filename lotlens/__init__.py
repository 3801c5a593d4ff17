"""Used-vehicle market analytics on Spark."""
