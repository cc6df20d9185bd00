"""docloom: document retrieval, evaluation and corpus analytics as PySpark DataFrame plans."""

__version__ = "0.1.0"
