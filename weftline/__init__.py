"""weftline: web-document extraction and data-quality analytics on Spark."""

__version__ = "0.1.0"
