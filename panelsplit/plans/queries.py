"""All registered driver queries (importing the modules fills the registry)."""

from . import q_checks, q_core, q_decompose, q_metrics  # noqa: F401  (order: audit uses the others)
from . import q_audit, q_files, q_landed, q_publish  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
