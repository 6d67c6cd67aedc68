"""orrery: exact vector search over chunked embeddings, expressed in PySpark DataFrames."""

__version__ = "0.1.0"
