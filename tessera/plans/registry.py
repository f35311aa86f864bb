"""All queries over the cohort operators, by name, and their DuckDB SQL.

The driver's tables have no genotypes: each query maps an operator onto the columns that have its shape (reads: l_quantity
and l_linenumber; sites: parts; samples: suppliers; positions: seconds of events; segments: a user's runs of events).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


from . import assignments, cohort, evidence, intervals, linking, maps, panels, paths, ranking, relations, selection  # noqa: E402, F401
