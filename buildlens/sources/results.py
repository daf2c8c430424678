"""Result files of builds, and the metric rows made from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens import schemas
from buildlens.session import scratch, shuffles_deleted


# Files up to this size are read as a whole, larger ones line by line.
WHOLE_BYTES = 64 << 20
# Lines of a compressed file that is written, some 20 MB of text.
PACKED_LINES = 200_000
_LONGS = [f.name for f in schemas.CI_RESULT.fields if isinstance(f.dataType, T.LongType)]
# A record as it is parsed: numbers stay text until it is known whether they are some.
_RECORD = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name in _LONGS else f.dataType) for f in schemas.CI_RESULT.fields]
    + [T.StructField("run_key", T.StringType())])


def _whole_files(rows: DataFrame) -> DataFrame:
    """``source, r, edge, error``: the records of files that were read as one text each."""
    # A line end cannot stand inside a JSON text, so this joins arrays and nothing else.
    one = F.regexp_replace("value", r"\]\s*\n\s*\[", ",")
    found = F.from_json(one, T.ArrayType(_RECORD), {"mode": "PERMISSIVE"})
    good = F.transform(found, lambda r: F.struct(
        r.alias("r"), F.when(r.isNull(), "a record is no object").alias("error")))
    bad = F.array(F.struct(F.lit(None).cast(_RECORD).alias("r"), F.lit("not JSON arrays").alias("error")))
    return rows.filter(F.length(F.trim("value")) > 0) \
        .select("source", F.explode(F.coalesce(good, bad)).alias("x")) \
        .select("source", "x.r", F.lit(0).alias("edge"), "x.error")


def _by_line(rows: DataFrame) -> DataFrame:
    """``source, r, edge, error``: a record, or an end of an array, or an error on each line."""
    text = F.trim(F.regexp_replace("value", r"\s+$", ""))
    alone = text.startswith("[{") & text.endswith("}]")
    bare = F.when(alone, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.rtrim(text, F.lit(",")))
    r = F.when(bare.startswith("{"), F.from_json(bare, _RECORD, {"mode": "PERMISSIVE"}))
    edge = F.when(text == "[", 1).when(text == "]", -1).otherwise(0)
    # What cannot be parsed is a record without any field.
    broken = F.coalesce(F.to_json(r) == "{}", F.lit(True)) & (edge == 0)
    return rows.filter(F.length(F.trim("value")) > 0).select(
        "source", F.when(~broken, r).alias("r"), edge.alias("edge"),
        F.when(broken, "a line is no record").alias("error"))


def read_ci_results(
    spark: SparkSession, path: str, layout: str = "files"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, runs, notifies) of result files, with ``source``, ``run_key`` and ``_error``.

    ``files``: JSON arrays, each beginning on a line of its own, ``source`` names the file.
    Files of up to ``WHOLE_BYTES`` may be laid out in any way; larger ones, which are read line
    by line and in pieces, need a line for each record and for each end of an array, or for an
    array of one record, as :func:`write_ci_results` gives them. A file that is something else,
    such as half an array, is a row of the tasks with its ``_error``, and gives no records.
    ``lines``: every file line by line, whatever its arrays look like; ``run_key`` names the
    run in files that this library wrote. A record with a number that is none, or without
    being an object, has it named in ``_error``.

    The files are read once: records are stored by kind, and the three tables read theirs.
    """
    if layout not in ("files", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    source = F.col("_metadata.file_path").alias("source")
    lines = spark.read.text(path)
    if layout == "files":
        # Sizes are known from the listing, so each file is opened by one of the two.
        small = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= WHOLE_BYTES)
        large = lines.filter(F.col("_metadata.file_size") > WHOLE_BYTES)
        rows = _whole_files(small.select("value", source)).unionByName(_by_line(large.select("value", source)))
    else:
        rows = _by_line(lines.select("value", source))
    kind = (
        F.when(F.col("r").isNull(), "edge")
        .when(F.col("r.type").isin(*schemas.RUN_TYPES), "run")
        .when(F.col("r.type") == schemas.NOTIFY_TYPE, "notify").otherwise("task")
    )
    numbers = {n: F.col(n).try_cast("bigint") for n in _LONGS}
    wrong = [F.when(F.col(n).isNotNull() & numbers[n].isNull(), F.concat(F.lit(f"{n} is no number: "), F.col(n)))
             for n in _LONGS]
    flat = rows.select("source", "edge", "error", kind.alias("kind"), "r.*") \
        .withColumn("_error", F.nullif(F.concat_ws("; ", *wrong), F.lit(""))).withColumns(numbers)
    folder = scratch(spark, "ci-results")
    flat.write.partitionBy("kind").parquet(folder)
    stored = spark.read.schema(flat.schema).parquet(folder)
    # Written too, so that the planner knows how few files these are, and does not shuffle records for them.
    folder = scratch(spark, "ci-errors")
    stored.filter(F.col("kind") == "edge").groupBy("source").agg(
        F.sum("edge").alias("open"), F.max("error").alias("__e")
    ).select("source", F.coalesce("__e", F.when(F.col("open") != 0, "an array has no end")).alias("__e")) \
        .filter(F.col("__e").isNotNull()).hint("rebalance").write.parquet(folder)
    bad = spark.read.schema("source string, __e string").parquet(folder)

    def of(name: str, fields: list[str]) -> DataFrame:
        out = stored.filter(F.col("kind") == name)
        if layout == "files":
            out = out.join(bad, "source", "left_anti")
        return out.select("source", "run_key", *fields, "_error")

    errors = bad if layout == "files" else \
        stored.filter((F.col("kind") == "edge") & F.col("error").isNotNull()).select("source", F.col("error").alias("__e"))
    tasks = of("task", schemas.TASK_RESULT_FIELDS).unionByName(
        errors.select("source", F.col("__e").alias("_error")), allowMissingColumns=True)
    return tasks, of("run", schemas.RUN_RESULT_FIELDS), of("notify", schemas.NOTIFY_RESULT_FIELDS)


def write_ci_results(
    tasks: DataFrame, runs: DataFrame, path: str, key: str = "run_id",
    notifies: DataFrame | None = None, mode: str = "errorifexists", crowd: int = 1_000_000,
    compression: str | None = None,
) -> None:
    """A JSON array per run: its task rows, its run row, then its notify row if any.

    The records of a run are adjacent lines of sorted files, and its array is whole in one
    file. The tasks of a run with more than ``crowd`` of them spread over files, and so each
    is an array of its own on one line; so is a task of a key without a run row. Every file
    holds whole arrays and is read by both layouts. Nothing is collected per run.

    With a ``compression``, such as ``gzip``, files are made of about ``PACKED_LINES`` lines each
    and runs of more tasks are spread, since a reader sees only the compressed size of a file.
    """
    spark = tasks.sparkSession

    def record(df: DataFrame, names: list[str]) -> Column:
        fields = [F.col(n) for n in names if n in df.columns]
        return F.to_json(F.struct(F.col(key).cast("string").alias("run_key"), *fields))

    def line(df: DataFrame, position: int, text: Column) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.lit(position).alias("p"), text.alias("value"))

    run_record = record(runs, schemas.RUN_RESULT_FIELDS)
    records = line(tasks, 1, record(tasks, schemas.TASK_RESULT_FIELDS)).unionByName(
        line(runs, 2, F.concat(run_record, F.lit("," if notifies is not None else ""))))
    if notifies is not None:
        records = records.unionByName(line(notifies, 3, record(notifies, schemas.NOTIFY_RESULT_FIELDS)))
    with shuffles_deleted(spark):
        # Stored, since they are read more than once, and what was shuffled to make them goes before they are shuffled.
        folder = scratch(spark, "ci-records")
        records.write.parquet(folder, compression="zstd")
        records = spark.read.schema(records.schema).parquet(folder)
        files = []
        if compression:
            crowd = min(crowd, PACKED_LINES)
            # A run has two lines more than its record. What fits into one file is left to the planner.
            n = math.ceil((records.count() + 2 * records.filter(F.col("p") == 2).count()) / PACKED_LINES)
            files = [n] if n > 1 else []
        # Crowds are few. They are written too, so that the planner knows it and shuffles the records once.
        folder = scratch(spark, "ci-crowds")
        records.filter(F.col("p") == 1).groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > crowd) \
            .select("k", F.ceil(F.col("n") / F.lit(crowd)).alias("parts")).hint("rebalance").write.parquet(folder)
        crowds = spark.read.schema(T.StructType([records.schema["k"], T.StructField("parts", T.LongType())])).parquet(folder)
        # Rows that agree in k and part are never dealt to different files.
        spread = F.when(F.col("p") == 1, F.pmod(F.xxhash64("value"), "parts") + 1)
        dealt = records.join(crowds, "k", "left").select("k", F.coalesce(spread, F.lit(0)).alias("part"), "p", "value") \
            .repartitionByRange(*files, "k", "part")
        frame = F.array(*[F.struct(p.alias("p"), v.alias("value")) for p, v in (
            (F.lit(0), F.lit("[")), (F.col("p"), F.col("value")), (F.lit(4), F.lit("]")))])
        lines = dealt.select("k", "part", F.explode(
            F.when(F.col("p") == 2, frame).otherwise(F.slice(frame, 2, 1))).alias("l")).select("k", "part", "l.*")
        # The line that opens its array comes first; where it does not, a task has no run.
        opened = F.first("p").over(Window.partitionBy("k", "part").orderBy("p", "value"))
        alone = (F.col("part") > 0) | (F.col("k").isNotNull() & (F.col("opened") != 0))
        task = F.col("p") == 1
        value = F.when(task & alone, F.concat(F.lit("["), F.col("value"), F.lit("]"))) \
            .when(task, F.concat("value", F.lit(","))).otherwise(F.col("value"))
        (
            lines.withColumn("opened", opened).sortWithinPartitions("k", "part", "p", "value")
            .select(value.alias("value")).write.mode(mode).text(path, compression=compression)
        )


def read_it_subtasks(df: DataFrame, col: str = "description") -> DataFrame:
    """One row per sub-test of a JSON array; no description gives no rows."""
    subs = F.posexplode(F.from_json(col, schemas.IT_SUBTASKS)).alias("sub_no", "__sub")
    return (
        df.filter(F.length(col) > 0)
        .select(*[c for c in df.columns if c != col], subs)
        .withColumn("status", F.col("__sub.status")).drop("__sub")
    )


def read_codecov_totals(df: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Coverage totals of an answer; other answers than 200 give nulls."""
    totals = F.from_json(
        F.when(F.col(status) == 200, F.col(body)), schemas.COVERAGE_TOTALS
    )["commit"]["totals"]
    work = df.withColumn("__t", totals)
    names = {"c": "coverage", "f": "files", "n": "lines", "h": "hits", "m": "misses", "p": "partials"}
    diff = ["files", "lines", "hits", "misses", "partials", "coverage"]
    return work.select(
        *[c for c in df.columns if c != body],
        *[F.col("__t")[k].alias(v) for k, v in names.items()],
        *[F.get(F.col("__t.diff"), F.lit(i)).alias(f"diff_{n}") for i, n in enumerate(diff)],
    )


def read_image_tags(df: DataFrame, col: str = "tags") -> DataFrame:
    """Distinct tag names of JSON arrays, in byte order."""
    return (
        df.select(F.explode(F.from_json(col, schemas.IMAGE_TAGS)).alias("t"))
        .select(F.col("t.name").alias("name")).filter(F.col("name").isNotNull())
        .distinct().orderBy("name")
    )


def write_facts(df: DataFrame, path: str) -> None:
    """Append metric rows; readers of one repository touch only its folder.

    Rows are rebalanced by repository: small ones share a task, and a repository with
    very many rows is cut into pieces of the advisory size.
    """
    df.hint("rebalance", "repo").write.partitionBy("repo").mode("append").parquet(path)
