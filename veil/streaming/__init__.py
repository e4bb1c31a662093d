"""The same over streams."""
