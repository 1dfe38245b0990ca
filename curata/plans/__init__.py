"""Queries over the driver's tables, each with its DuckDB oracle."""

from curata.plans import assembly, curation, enrichment, scoring, surface

QUERIES = {**curation.QUERIES, **scoring.QUERIES, **enrichment.QUERIES, **assembly.QUERIES, **surface.QUERIES}
ORACLE_SQL = {**curation.ORACLE_SQL, **scoring.ORACLE_SQL, **enrichment.ORACLE_SQL, **assembly.ORACLE_SQL, **surface.ORACLE_SQL}
