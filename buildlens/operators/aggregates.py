"""Counts, outcomes and gates. All of them combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.functions import results


def _is(col: str, value: str) -> Column:
    return F.col(col).eqNullSafe(F.lit(value))


def it_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-test counts; whatever is not ``success``, missing statuses too, failed."""
    ok = _is("status", "success")
    return (
        df.groupBy(*keys)
        .agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
        .withColumn("total", F.col("success") + F.col("failed"))
        .withColumn("summary", results.it_message(F.col("success"), F.col("failed")))
    )


def run_outcome(runs: DataFrame, tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """``result`` and ``status`` per run: failed if any task did not succeed.

    A run without tasks has passed.
    """
    ok = tasks.groupBy(key).agg(
        F.bool_and(results.succeeded(F.col("result"))).alias("__ok"),
        F.count("*").alias("__tasks"),
    )
    passed = F.coalesce("__ok", F.lit(True))
    return (
        runs.drop("result", "status").join(ok, key, "left")
        .withColumn("tasks", F.coalesce("__tasks", F.lit(0)))
        .withColumn("status", F.when(passed, "passed").otherwise("failed"))
        .withColumn("result", F.when(passed, "SUCCESS").otherwise("FAILURE"))
        .drop("__ok", "__tasks")
    )


def plan_outcome(df: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of plan executions from their latest status, and how many are open."""
    error = F.coalesce(F.col("status").isin(*fixed.ERROR_STATES), F.lit(False))
    final = F.coalesce(F.col("status").isin(*fixed.FINAL_STATES), F.lit(False))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("executions"), F.count_if(~final).alias("open"),
             F.bool_or(error).alias("__error"))
        .withColumn("outcome", F.when(F.col("__error"), "failed").otherwise("passed"))
        .drop("__error")
    )


def junit_summary(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Cases by outcome; any failed or broken case makes the report a FAILURE."""
    def n(outcome: str) -> Column:
        return F.count_if(_is("outcome", outcome)).alias(outcome)

    return (
        cases.groupBy(*keys)
        .agg(n("passed"), n("failed"), n("error"), n("skipped"), F.count("*").alias("total"))
        .withColumn(
            "result",
            F.when((F.col("failed") > 0) | (F.col("error") > 0), "FAILURE").otherwise("SUCCESS"),
        )
    )


def coverage_gate(
    lines: DataFrame, keys: list[str], target: float = fixed.COVERAGE_TARGET
) -> DataFrame:
    """Line rate in percent against the target."""
    return (
        lines.groupBy(*keys)
        .agg(F.sum("hit").alias("hits"), F.count("hit").alias("lines"))
        .withColumn("rate", F.col("hits") * F.lit(100.0) / F.nullif("lines", F.lit(0)))
        .withColumn("passed", F.col("rate") >= F.lit(float(target)))
    )


def cyclo_summary(
    df: DataFrame, keys: list[str], over: int = fixed.COMPLEXITY_LIMIT
) -> DataFrame:
    """Functions above the limit, and the average over all functions."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("functions"),
             F.count_if(F.col("complexity") > over).alias("over_limit"),
             F.max("complexity").alias("worst"),
             F.sum("complexity").alias("__sum"))
        .withColumn("average", F.col("__sum") / F.col("functions"))
        .drop("__sum")
    )


def finding_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("findings"))


def vulnerability_summary(
    df: DataFrame, keys: list[str], levels: list[str] = ["CRITICAL", "HIGH", "MEDIUM", "LOW"],
    images: list[str] | None = None,
) -> DataFrame:
    """One column per severity; the levels are given, so no extra pass finds them.

    ``images`` restricts the report to these images.
    """
    if images is not None:
        df = df.filter(F.col("image").isin(*images))
    return df.groupBy(*keys).agg(
        *[F.count_if(_is("severity", level)).alias(level.lower()) for level in levels],
        F.count("*").alias("total"),
    )


def assemble_hotfix(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``results``: a map of product to its links, as JSON, per hotfix.

    Rows are build steps (product, arch, url, patch_url, image). Per product the last
    write of each link counts; the patch link has one name for every arch. After that
    reduction a hotfix holds one row per product, which is what is collected.
    """
    def last(col: str, when: Column | None = None) -> Column:
        known = F.col(col).isNotNull()
        return F.max_by(col, F.when(known if when is None else known & when, order))

    links = {
        "amd64": last("url", F.col("arch") == "amd64"),
        "arm64": last("url", F.col("arch") == "arm64"),
        "image": last("image"),
        "tiup-patch-amd64": last("patch_url"),
    }
    per_product = df.groupBy(*keys, "product").agg(*[c.alias(n) for n, c in links.items()])
    pairs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v")) for n in links]),
        lambda p: p["v"].isNotNull(),
    )
    entry = F.struct(F.col("product"), F.array_sort(pairs).alias("links"))
    # Sorted as arrays, since maps cannot be ordered; turned into maps afterwards.
    products = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(e["product"], F.map_from_entries(e["links"])),
    )
    return per_product.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(products)).alias("results")
    )


def notify_receivers(
    receivers: Column, author: Column, trigger: Column, flow: str = "current",
    unique: bool = False,
) -> Column:
    """Who is told about a run.

    Current flow: the list of the config, then the author, then the trigger, each if
    given, copies kept; without a list there is nobody. Legacy flow: the author, and
    the trigger where it is somebody else.
    """
    def given(c: Column) -> Column:
        return F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))

    if flow == "current":
        out = F.concat(receivers, given(author), given(trigger))
    elif flow == "legacy":
        other = F.when(~author.eqNullSafe(trigger), trigger)
        out = F.concat(F.array(author), given(other))
    else:
        raise ValueError(f"unknown flow {flow!r}")
    return F.array_distinct(out) if unique else out


def task_time(
    df: DataFrame, keys: list[str], start: str = "start_ms", duration: str = "duration_ms"
) -> DataFrame:
    """Sum of task times against the time from first start to last end."""
    s, d = F.col(start), F.col(duration)
    return df.groupBy(*keys).agg(
        F.count("*").alias("tasks"),
        F.sum(d).alias("total_ms"),
        (F.max(s + d) - F.min(s)).alias("wall_ms"),
    )
