"""sources of the cells engine."""
