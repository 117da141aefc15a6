"""The registered queries of the lake's operators and their DuckDB counterparts."""

from digestlake.plans import call_queries, digest_queries, lake_queries, source_queries

PARTS = [digest_queries.C, lake_queries.C, source_queries.C, call_queries.C]
QUERIES = {name: query for part in PARTS for name, query in part.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.oracles.items()}
