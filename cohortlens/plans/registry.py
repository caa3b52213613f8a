"""All queries of the engine by name, and the SQL each must agree with."""

from . import cohort_queries, concept_queries, evidence_queries, study_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
