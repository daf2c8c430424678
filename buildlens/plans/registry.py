"""The table of queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from buildlens.plans.bindings import BINDINGS, DERIVED

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {**BINDINGS, **DERIVED}


def _mentioned(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def needed_views(sql: str) -> list[str]:
    """Views a text uses, in an order in which each finds what it builds on."""
    out: list[str] = []
    for name in _mentioned(sql, VIEWS):
        for inner in [*needed_views(VIEWS[name]), name]:
            if inner not in out:
                out.append(inner)
    return out


def with_views(sql: str) -> str:
    """The text with the views it uses in front, as DuckDB runs it."""
    views = [f"{n} AS ({VIEWS[n].strip()})" for n in needed_views(sql)]
    sql = sql.strip()
    if not views:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(views) + "\n" + sql


class Inputs:
    """The given tables of one folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for name in _mentioned(full, TABLES):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(full)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Inputs` under a name."""
    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return add
