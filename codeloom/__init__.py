"""codeloom: analytics and retrieval over source repositories and documents, on Spark."""

__version__ = "0.1.0"
