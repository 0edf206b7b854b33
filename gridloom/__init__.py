"""gridloom: a Spark engine that turns messy human-formatted tables into tidy relations."""

__version__ = "0.1.0"
