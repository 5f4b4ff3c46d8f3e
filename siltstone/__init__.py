"""Source-text analytics and training-data operators on Spark."""
