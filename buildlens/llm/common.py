"""What several operators of this package share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.session import apply_settings, scratch

# ASCII white space, U+0020 and U+0009 to U+000D, as ``bytes.split`` cuts it.
SPACE = "[\\x20\\x09-\\x0D]"
# Rows and bytes of a batch that a task turns into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
# What a row of some numbers takes as Python objects, besides its text.
ROW_BYTES = 256


def ready(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of the size that tasks work on."""
    apply_settings(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SLICE_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text, as bytes; of a null none."""
    return text.encode().split() if text else []


def remainder(doc_id: str, n: int):
    """crc32 of an id as text, modulo ``n``; of a null id null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: the lineage ends here."""
    spark = ready(df.sparkSession)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_task(key, make: Callable[[], object]) -> object:
    """``make()``, once per Python worker and key: vocabularies are costly to load.

    Functions reach the workers by value, each with globals of its own, so what is to last
    longer than one of them is kept in a module that every worker has.
    """
    kept = sys.__dict__.setdefault("_buildlens_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in small batches; a very long row comes alone."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batched(schema: pa.Schema, rows: Iterator[tuple], text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches, each given out once it holds ``SLICE_BYTES``.

    For rows that take more space than what they are made from: unpacked texts, windows.
    """
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += ROW_BYTES + len(row[text_at] or "")
        if size >= SLICE_BYTES:
            yield record_batch(schema, list(map(list, zip(*out))))
            out, size = [], 0
    if out:
        yield record_batch(schema, list(map(list, zip(*out))))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)
