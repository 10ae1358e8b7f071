"""Genealogical analytics and table hygiene as declarative Spark plans."""

__version__ = "0.1.0"
