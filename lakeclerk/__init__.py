"""Batch table pipelines and a data catalogue kept as tables, on PySpark."""

from lakeclerk.catalog import Catalog

__all__ = ["Catalog"]
