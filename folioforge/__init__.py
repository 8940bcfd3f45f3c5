"""Document analytics and cited retrieval as Spark plans."""

__version__ = "0.1.0"
