"""Named queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from spanforge.plans import chunking_queries, evaluation_queries, experiment_queries, judging_queries, markdown_queries, retrieval_queries

_MODULES = [markdown_queries, chunking_queries, retrieval_queries, evaluation_queries, experiment_queries, judging_queries]


def flagship(spark, sf_dir):
    return retrieval_queries.hybrid_search(spark, sf_dir)


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
