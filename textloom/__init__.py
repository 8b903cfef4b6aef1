"""textloom: document-analytics operators for PySpark DataFrames."""

__version__ = "0.1.0"
