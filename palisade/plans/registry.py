"""Registered queries of the access engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.plans import context, control_queries, data_queries, finance, score_queries
from palisade.plans.workload import DECISIONS, WORKLOAD

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = ("analyst", "SELECT c_name, c_acctbal, COUNT(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name, c_acctbal")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and a count, realigned for a role that may not see names and sees one market segment only."""
    return context.engine(spark, sf_dir).execute_query(FLAGSHIP[1], FLAGSHIP[0])


def _run(role: str, sql: str) -> Query:
    return lambda spark, sf_dir: context.engine(spark, sf_dir).execute_query(sql, role)


def queries() -> dict[str, Query]:
    own: dict[str, Query] = {"flagship": flagship}
    own |= {f"run_{name}": _run(role, sql) for name, (role, sql, _) in WORKLOAD.items()}
    return own | control_queries.QUERIES | finance.QUERIES | data_queries.QUERIES | score_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    own = {"flagship": "SELECT c_acctbal, COUNT(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_name, c_acctbal"}
    own |= {f"run_{name}": want for name, (_, _, want) in WORKLOAD.items()}
    return own | control_queries.ORACLES | finance.ORACLES | data_queries.ORACLES | score_queries.ORACLES


__all__ = ["DECISIONS", "flagship", "oracle_sql", "queries"]
