"""operators of the cells engine."""
