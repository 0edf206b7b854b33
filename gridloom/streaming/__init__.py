"""streaming of the cells engine."""
