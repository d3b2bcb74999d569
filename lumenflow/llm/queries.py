"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import exact_dedup, extract, licenses, lm_score, mixing, near_dedup, packing, quality, secrets, toxicity

_MODULES = (exact_dedup, secrets, packing, lm_score, mixing, licenses, quality, extract, toxicity, near_dedup)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.SQL.items()}
