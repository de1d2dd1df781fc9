"""The registered queries of the retrieval operators and their SQL."""

from quillon.plans import composed, paged, worded  # noqa: F401  register their queries
from quillon.plans.retrieval import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
