"""Operators for large-scale training-data pipelines. Nothing else in gridloom imports this subpackage."""
