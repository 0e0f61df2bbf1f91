"""Steps of the pipeline as DataFrame operations."""
