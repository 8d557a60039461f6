"""Registered queries and their SQL."""

from . import foundations, metrics, models, retrieval, statistics, texts, vectors, worlds
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "foundations", "metrics", "retrieval", "models", "statistics", "texts", "vectors", "worlds"]
