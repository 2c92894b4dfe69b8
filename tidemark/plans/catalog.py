"""Every registered query; importing the modules fills the registry."""

from tidemark.plans import (  # noqa: F401
    queries_catalog,
    queries_changes,
    queries_concepts,
    queries_graph,
    queries_run,
    queries_sources,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
