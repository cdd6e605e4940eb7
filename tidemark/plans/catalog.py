"""Imports every module that registers queries."""

from tidemark.plans import admission_queries, composite_queries, evidence_queries, function_queries, identity_queries, lifecycle_queries, moderation_queries, page_queries, read_model_queries, relational_queries, sentence_queries, state_queries, walk_queries  # noqa: F401
from tidemark.plans.registry import CASES, ORACLES, QUERIES

__all__ = ["CASES", "ORACLES", "QUERIES"]
