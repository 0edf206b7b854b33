"""functions of the cells engine."""
