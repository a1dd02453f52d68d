"""All registered queries; importing this module fills the registry."""

from blastradius.plans import artifact_queries, catalog_queries, impact_queries, match_queries, rollup_queries, text_queries  # noqa: F401
from blastradius.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
