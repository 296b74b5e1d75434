"""Registered queries. Importing this package fills ``registry.REGISTRY``."""

from runlens.plans import corpus_queries, evaluation_queries, explanation_queries, feature_queries, live_queries, model_queries, source_queries  # noqa: F401
from runlens.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
