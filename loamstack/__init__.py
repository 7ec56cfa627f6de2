"""loamstack: hybrid document retrieval and corpus processing as PySpark plans."""

__version__ = "0.1.0"
