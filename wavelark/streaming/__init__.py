"""The first stage over streams."""
