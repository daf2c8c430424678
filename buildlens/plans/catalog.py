"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from buildlens.plans import (  # noqa: F401  (register queries)
    files, lookups, nightly, rows, scalars, streams, summaries,
)
from buildlens.plans.registry import QUERIES, Inputs
from buildlens.session import apply_settings


def names() -> list[str]:
    return list(QUERIES)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].build(Inputs(apply_settings(spark), folder))


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return partial(run, name)


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
