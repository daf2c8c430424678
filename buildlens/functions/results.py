"""Outcomes of builds and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.site import DEFAULT_SITE, Site


def succeeded(result: Column) -> Column:
    """True only for SUCCESS; a missing result is a failure."""
    return result.eqNullSafe(F.lit("SUCCESS"))


def detail_url(
    project: Column, number: Column, result: Column, task: Column, legacy: bool = False,
    site: Site = DEFAULT_SITE,
) -> Column:
    """Page of a build: its tests where a test task did not succeed, else its pipeline."""
    test_tasks = fixed.LEGACY_TEST_TASKS if legacy else fixed.TEST_TASKS
    tests = ~succeeded(result) & F.coalesce(task.isin(*test_tasks), F.lit(False))
    return F.concat(
        stored_url(project, number, tab="", site=site),
        F.when(tests, "tests").otherwise("pipeline"),
    )


def stored_url(
    project: Column, number: Column, tab: str = "pipeline", site: Site = DEFAULT_SITE
) -> Column:
    """The page kept in a result row; it is always the pipeline page."""
    return F.concat(
        F.lit(f"{site.ci_base}/blue/organizations/jenkins/"), project, F.lit("/detail/"),
        project, F.lit("/"), number.cast("string"), F.lit(f"/{tab}"),
    )


_DETAIL = r"/blue/organizations/jenkins/(.+)/detail/(.+)/(\d+)/(tests|pipeline)$"


def parse_detail_url(c: Column) -> Column:
    def field(group: int) -> Column:
        return F.nullif(F.regexp_extract(c, _DETAIL, group), F.lit(""))

    return F.struct(
        F.parse_url(c, F.lit("HOST")).alias("host"),
        field(1).alias("project"),
        field(3).cast("bigint").alias("number"),
        field(4).alias("tab"),
    )


def commit_status(result: Column) -> Column:
    """struct(state, description) as posted for a commit."""
    state, text = map(F.lit, fixed.COMMIT_STATE_DEFAULT)
    for value, its_state, its_text in fixed.COMMIT_STATES:
        state = F.when(result == value, its_state).otherwise(state)
        text = F.when(result == value, its_text).otherwise(text)
    return F.struct(state.alias("state"), text.alias("description"))


def classify_failure(exc_class: Column, message: Column, variant: str = "job") -> Column:
    """Result of a build that ended with an exception.

    A user's interrupt aborts a job but fails a merge run. Work found done already
    is raised as an exception too and counts as success.
    """
    name = F.coalesce(F.substring_index(exc_class, ".", -1), F.lit("Exception"))
    message = F.coalesce(message, F.lit(""))
    interrupted = "FAILURE" if variant == "merge" else "ABORTED"
    return (
        F.when(name == "FlowInterruptedException", interrupted)
        .when(
            name == "AbortException",
            F.when(message.contains(fixed.KILLED_MESSAGE), "ABORTED")
            .otherwise("FAILURE"),
        )
        .when(name == "InterruptedException", "ABORTED")
        .when(message.isin(*fixed.DONE_MESSAGES), "SUCCESS")
        .otherwise("FAILURE")
    )


def unstable_to_failure(c: Column) -> Column:
    return F.when(c == "UNSTABLE", "FAILURE").otherwise(c)


def coverage_message(rate: Column) -> Column:
    rounded = F.round(rate.cast("float"), 2).cast("string")
    return F.concat(F.lit("Lines coverage "), rounded, F.lit("%."))


def append_summary(a: Column, b: Column) -> Column:
    return F.when(b != "", F.concat(a, b)).otherwise(a)


def task_line(name: Column, result: Column, summary: Column) -> Column:
    head = F.concat_ws(" ", name, result)
    return F.when(F.length(summary) > 0, F.concat(head, F.lit(": "), summary)).otherwise(head)


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def it_message(success: Column, failed: Column) -> Column:
    total = success + failed
    return F.when(
        failed > 0,
        F.format_string("failed %d, success %d, total %d", failed, success, total),
    ).otherwise(F.format_string("all %d tests passed", total))
