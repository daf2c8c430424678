"""Task rows: defaults, and the fields they take from their run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.functions import artifacts, tasks
from buildlens.site import DEFAULT_SITE, Site


def apply_task_defaults(df: DataFrame) -> DataFrame:
    """Defaults for the columns ``timeout`` and ``retry``, and ``resources`` if present."""
    out = df.withColumns({
        "timeout": tasks.default_timeout(F.col("timeout")),
        "retry": tasks.default_retry(F.col("retry")),
    })
    if "resources" in df.columns:
        out = out.withColumn("resources", tasks.default_resources(F.col("resources")))
    return out


def attach_run_fields(runs: DataFrame, site: Site = DEFAULT_SITE) -> DataFrame:
    """One row per task of ``runs.tasks``; run fields win over those in the task."""
    run_fields = ["pipelineName", "triggerEvent", "branch", "commitID", "pullRequest", "repo", "owner"]
    exploded = runs.withColumn("task", F.explode("tasks"))
    own = [f.name for f in exploded.schema["task"].dataType.fields
           if f.name not in {*run_fields, "cacheCodeURL"}]
    path = artifacts.artifact_path(
        "code_cache", product=F.col("repo"), commit=F.col("commitID"), site=site
    )
    return exploded.select(
        F.col("id").alias("run_id"),
        *[F.col("task")[name].alias(name) for name in own],
        *run_fields,
        F.concat(F.lit(f"{site.file_server}/download/"), path).alias("cacheCodeURL"),
    )


def missing_fields(row: dict[str, Column] | None = None,
                   required: list[str] = fixed.REQUIRED_BUILD_FIELDS) -> Column:
    """Names of required parameters a build request lacks; a tag or a branch must be set."""
    col = (row or {}).get

    def empty(name: str) -> Column:
        c = col(name) if col(name) is not None else F.col(name)
        return F.coalesce(c == "", F.lit(True))

    gaps = [F.when(empty(n), F.lit(n)) for n in required]
    gaps.append(F.when(empty("RELEASE_TAG") & empty("TARGET_BRANCH"),
                       F.lit("RELEASE_TAG|TARGET_BRANCH")))
    return F.array_compact(F.array(*gaps))


def missing_field_counts(df: DataFrame, required: list[str] = fixed.REQUIRED_BUILD_FIELDS) -> DataFrame:
    """One row per missing parameter with the number of requests that lack it."""
    return (
        df.select(F.explode(missing_fields(required=required)).alias("field"))
        .groupBy("field").agg(F.count("*").alias("requests"))
    )
