"""Evidence-preserving geospatial entity resolution as Spark DataFrame transformations."""

__version__ = "0.1.0"
