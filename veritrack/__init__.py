"""Position-integrity analytics and training-data operators on Spark."""
