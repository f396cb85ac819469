"""Tessera: a Spark-first engine for ragged, per-record scientific data and its evaluation."""

__version__ = "0.1.0"
