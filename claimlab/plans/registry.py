"""All registered queries by key."""

from __future__ import annotations

from claimlab.plans import distribution_queries, linkage_queries, source_queries, summary_queries
from claimlab.plans.base import Query

_MODULES = (source_queries, summary_queries, linkage_queries, distribution_queries)
ALL: dict[str, Query] = {query.key: query for module in _MODULES for query in module.QUERIES}
