"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from foretide.plans import commit_queries, detail_queries, feed_queries, ledger_queries, lifecycle_queries, rating_queries, report_queries, source_queries, store_queries

_PARTS = (rating_queries, ledger_queries, lifecycle_queries, store_queries, report_queries, source_queries, feed_queries, commit_queries, detail_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {"all_sources_landed": source_queries.ORACLES["all_sources"]} | {k: s for part in _PARTS for k, s in part.ORACLES.items()}
