"""Lychnos: document extraction, retrieval and record cleaning on PySpark DataFrames."""

__version__ = "0.1.0"
