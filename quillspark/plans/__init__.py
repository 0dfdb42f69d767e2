"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from quillspark.plans import analytics, assessments, clusters, entities, indexing, reports, retrieval, sheets, wording
from quillspark.plans.registry import Query


def queries() -> dict[str, Query]:
    return retrieval.QUERIES | analytics.QUERIES | reports.REGISTRY.queries | assessments.REGISTRY.queries | wording.REGISTRY.queries | clusters.REGISTRY.queries | indexing.REGISTRY.queries | sheets.REGISTRY.queries | entities.REGISTRY.queries


def oracles() -> dict[str, str]:
    return retrieval.ORACLES | analytics.ORACLES | reports.REGISTRY.oracles | assessments.REGISTRY.oracles | wording.REGISTRY.oracles | clusters.REGISTRY.oracles | indexing.REGISTRY.oracles | sheets.REGISTRY.oracles | entities.REGISTRY.oracles
