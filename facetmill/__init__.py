"""facetmill: a Spark-first engine for document-derived financial data."""

__version__ = "0.1.0"
