"""Test, coverage, complexity and version reports, and checksums."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import schemas
from buildlens.session import scratch

# Executors get the readers of files themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_junit(spark: SparkSession, path: str, allow_empty: bool = True) -> DataFrame:
    """One row per test case with its outcome; ``report`` names the file.

    Lint and security reports may be empty; for others pass ``allow_empty=False``, and
    a report without test cases is a row with the outcome ``empty``.
    """
    cases = (
        spark.read.format("xml").option("rowTag", "testcase").schema(schemas.JUNIT_CASE).load(path)
        .select(
            F.col("_metadata.file_name").alias("report"),
            F.col("_classname").alias("suite"),
            F.col("_name").alias("name"),
            F.col("_time").alias("time_s"),
            F.when(F.col("skipped").isNotNull(), "skipped")
            .when(F.col("error").isNotNull(), "error")
            .when(F.col("failure").isNotNull(), "failed")
            .otherwise("passed").alias("outcome"),
            F.coalesce("failure._message", "error._message", "skipped._message").alias("message"),
        )
    )
    if allow_empty:
        return cases
    # Only names are listed, no content is read. The reports are parsed once, into a table.
    listed = spark.read.format("binaryFile").load(path) \
        .select(F.col("_metadata.file_name").alias("report"))
    folder = scratch(spark, "junit-cases")
    cases.write.parquet(folder)
    stored = spark.read.schema(cases.schema).parquet(folder)
    empty = listed.join(stored.select("report").distinct(), "report", "left_anti")
    return stored.unionByName(
        empty.withColumns({"outcome": F.lit("empty"), "message": F.lit("no test cases")}),
        allowMissingColumns=True)


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """One row per source line with a hit flag."""
    return (
        spark.read.format("xml").option("rowTag", "class").schema(schemas.COBERTURA_CLASS).load(path)
        .select(F.col("_filename").alias("file"), F.col("_name").alias("class"),
                F.explode("lines.line").alias("line"))
        .select("file", "class", F.col("line._number").alias("line"),
                (F.col("line._hits") > 0).cast("int").alias("hit"))
    )


def read_cyclo_log(spark: SparkSession, path: str) -> DataFrame:
    """Functions of a complexity log; its last line, the average, is not one."""
    pattern = r"^(\d+) (\S+) (\S+) (\S+):(\d+):(\d+)$"

    def part(i: int):
        return F.regexp_extract("value", pattern, i)

    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(
        part(1).cast("bigint").alias("complexity"), part(2).alias("package"),
        part(3).alias("function"), part(4).alias("file"),
        part(5).cast("bigint").alias("line"), part(6).cast("bigint").alias("column"),
    )


def parse_version_info(df: DataFrame, col: str) -> DataFrame:
    """Commit and release tag printed by a binary; the tag loses its first ``v``."""
    lines = F.split(col, r"\r?\n")

    def value(label: str):
        line = F.get(F.filter(lines, lambda x: x.rlike(label)), F.lit(0))
        return F.trim(F.get(F.split(line, ":"), F.lit(1)))

    return df.withColumns({
        "commit": value("Git Commit Hash|Git commit hash"),
        "tag": F.regexp_replace(value("Release Version|Release version"), "^([^v]*)v", "$1"),
    })


def read_version_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, each holding what one binary printed."""
    text = spark.read.text(path, wholetext=True) \
        .select(F.col("_metadata.file_name").alias("binary"), "value")
    return parse_version_info(text, "value").drop("value")


def compare_checksums(
    sums: DataFrame, recorded: DataFrame, key: str = "path"
) -> DataFrame:
    """``status`` per file: same, different, or unrecorded where no sum is known."""
    known = recorded.groupBy(key).agg(F.max("checksum").alias("recorded"))
    return sums.join(known, key, "left").withColumn(
        "status",
        F.when(F.col("recorded").isNull(), "unrecorded")
        .when(F.col("recorded") == F.col("checksum"), "same").otherwise("different"),
    )


# Bytes of a file that are held at once.
CHUNK_BYTES = 8 << 20
_SUMS = r"\.(sha256sum|md5)$"


def _file_system(path: str) -> tuple:
    """The file system of a path as Spark names it, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest.removeprefix('//'))}")


def open_stream(path: str) -> BinaryIO:
    """A file that executors can reach, as a stream."""
    system, name = _file_system(path)
    return system.open_input_stream(name, compression=None)


def create_stream(path: str) -> BinaryIO:
    system, name = _file_system(path)
    return system.open_output_stream(name, compression=None)


def checksum_artifacts(
    spark: SparkSession, path: str, algorithm: str = "sha256",
    open_file: Callable[[str], BinaryIO] | None = open_stream,
) -> DataFrame:
    """Checksum per stored file; plugins use md5. Checksum files themselves are left out.

    Spark only lists the files. Tasks, which get files by their bytes, open each with
    ``open_file`` and feed it to the digest piece by piece, so files may have any size. Where
    only Spark can open the path, pass None; files are then read as one value and must stay
    below 2 GB. Empty files are not listed.
    """
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    files = spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike(_SUMS))
    if open_file is None:
        digest = F.sha2("content", 256) if algorithm == "sha256" else F.md5("content")
        return files.select("path", F.col("length").alias("bytes"), digest.alias("checksum"))
    size = CHUNK_BYTES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.new(algorithm)
                with open_file(name) as stream:
                    while piece := stream.read(size):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["path", "bytes", "checksum"])

    return files.select("path", F.col("length").alias("bytes")) \
        .mapInArrow(sums, "path string, bytes bigint, checksum string")


def write_checksums(sums: DataFrame, create_file: Callable[[str], BinaryIO] = create_stream) -> int:
    """``<sum>  <file>`` beside each file of ``sums`` (path, checksum); how many were written.

    A file is named after the one it belongs to and the kind of its sum. A task that runs
    again writes the same bytes.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, checksum in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                kind = "md5" if len(checksum) == 32 else "sha256sum"
                with create_file(f"{path}.{kind}") as out:
                    out.write(f"{checksum}  {path.rsplit('/', 1)[-1]}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = sums.select("path", "checksum").dropna().mapInArrow(put, "n bigint").agg(F.sum("n")).head()[0]
    return done or 0


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Recorded sums: ``<sum>  <file>`` in a file named after the one it belongs to."""
    return (
        # The pattern holds while files are listed: no artifact is opened.
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{sha256sum,md5}").load(path)
        .select(
            F.regexp_replace("path", r"\.(sha256sum|md5)$", "").alias("path"),
            F.substring_index(F.trim(F.col("content").cast("string")), " ", 1).alias("checksum"),
        )
    )
