"""Listing price analytics on PySpark: snapshots, deduplication, panels, rates, indices and models."""

__version__ = "0.1.0"
