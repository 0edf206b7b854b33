"""plans of the cells engine."""
