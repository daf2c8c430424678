"""User functions over task rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.operators.tasks import apply_task_defaults
from buildlens.session import scratch

# Executors get the function itself, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RESULTS = ("status", "result", "error")


def _attempts(body: Callable[[dict], str | None], task: dict) -> tuple:
    """What the first try that ends well returns, else what the last one raised."""
    error = None
    for _ in range(max(task["retry"] or 0, 1)):
        try:
            return "passed", body(task), None
        except Exception as e:
            error = str(e)
    return "failed", None, error


def run_checker(df: DataFrame, body: Callable[[dict], str | None]) -> DataFrame:
    """Call ``body(task)`` for every task row after its defaults are filled in.

    Adds ``status`` (passed or failed), ``result`` (what the body returned) and
    ``error`` (the text of what it raised). A body that raises is called again, ``retry``
    times in all; less than one means once. ``timeout`` is only handed over: ending a
    task that takes too long is up to the cluster. The task's own columns stay in their
    Arrow batch, so no value changes; the body sees whole numbers as such and nulls as
    None. One task is one row, so rows stay where they are.
    """
    ready = apply_task_defaults(df).drop(*_RESULTS)
    schema = T.StructType(
        ready.schema.fields + [T.StructField(n, T.StringType()) for n in _RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_attempts(body, task) for task in batch.to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(len(_RESULTS))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *_RESULTS])

    return ready.mapInArrow(run, schema)


class Checkers:
    """Checkers by task type.

    A checker is one of three: an expression, which gets the DataFrame and returns the
    text column it computes for a task; a body, called for each task as in
    :func:`run_checker`; or a frame, a function from the tasks of its type to a
    DataFrame with whatever columns it adds. Types without a checker are left out, as
    :meth:`skipped` shows.
    """

    def __init__(self) -> None:
        self._by_type: dict[str, tuple[str, Callable]] = {}

    def register(self, task_type: str, checker: Callable[[DataFrame], Column]) -> None:
        self._by_type[task_type] = ("expression", checker)

    def register_body(self, task_type: str, body: Callable[[dict], str | None]) -> None:
        self._by_type[task_type] = ("body", body)

    def register_frame(self, task_type: str, frame: Callable[[DataFrame], DataFrame]) -> None:
        self._by_type[task_type] = ("frame", frame)

    def run(self, df: DataFrame, out: str = "checked") -> DataFrame:
        """All expressions run in one pass, and all bodies in another.

        Frames get the tasks of their type. If there are several, these tasks are stored once
        by type and each frame reads its own, so the tasks are read three times at most,
        however many types are registered. Columns that only some checkers add are null for
        the others.
        """
        of = {kind: {t: c for t, (k, c) in self._by_type.items() if k == kind}
              for kind in ("expression", "body", "frame")}
        value, parts = F.lit(None).cast("string"), []
        for task_type, checker in of["expression"].items():
            value = F.when(F.col("task_type") == task_type, checker(df)).otherwise(value)
        if of["expression"] or not self._by_type:
            parts.append(df.filter(F.col("task_type").isin(*of["expression"])).withColumn(out, value))
        if of["body"]:
            bodies = of["body"]
            parts.append(run_checker(df.filter(F.col("task_type").isin(*bodies)),
                                     lambda task: bodies[task["task_type"]](task)))
        frames, stored = of["frame"], df
        if len(frames) > 1:
            folder = scratch(df.sparkSession, "tasks-by-type")
            kept = df.filter(F.col("task_type").isin(*frames)).withColumn("__of", F.col("task_type"))
            kept.write.partitionBy("__of").parquet(folder)
            stored = df.sparkSession.read.schema(kept.schema).parquet(folder)
        for task_type, frame in frames.items():
            own = stored.filter(F.col("__of" if len(frames) > 1 else "task_type") == task_type)
            parts.append(frame(own.select(*df.columns)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def skipped(self, df: DataFrame) -> DataFrame:
        known = F.coalesce(F.col("task_type").isin(*self._by_type), F.lit(False))
        return df.filter(~known).groupBy("task_type").agg(F.count("*").alias("skipped"))
