"""What the planner makes of the operators."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlens.plans import catalog

# Queries that read what they wrote, or run a stream, do their work when called.
EAGER = {"s1_run_specs", "s2_legacy_tasks", "s4_ci_results", "s6_junit", "s7_cobertura",
         "s11_cyclo_log", "s13_written_results", "s14_facts", "s15_stored_checksums"}
LAZY = [n for n in catalog.names() if n not in EAGER and not n.startswith("t")]
PYTHON = {"v1_run_checker"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, folder, name):
    plan = plan_of(catalog.run(name, spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


@pytest.mark.parametrize("family", ["p", "f", "x", "j12", "v2"])
def test_row_work_needs_no_shuffle(spark, folder, family):
    """Expressions and matrices add no exchange to the one the attempts view has."""
    shuffling = {"p24_times", "f8_known_task_types", "f8_dropped_task_types", "x1_prerelease_matrix",
                 "x2_nightly_matrix", "x3_tiup_matrix", "x7_missed_runs", "failed_runs", "j12_rules_table"}
    for name in LAZY:
        if name.startswith(family) and name not in shuffling:
            assert plan_of(catalog.run(name, spark, folder)).count("Exchange") <= 1, name


def test_rank_filter_runs_before_the_shuffle(spark, folder):
    plan = plan_of(catalog.run("w1_last_builds", spark, folder))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(catalog.run("f10_branch_filter", spark, folder))
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,en\)", plan)
    assert "text" not in re.search(r"ReadSchema: (struct<[^>]*lang[^>]*>)", plan).group(1)


def test_aggregations_combine_before_the_shuffle(spark, folder):
    for name in ("a1_it_summary", "a5_coverage_gate", "a7_finding_summary", "w3_latest_status",
                 "j9_multiarch_manifest"):
        assert "partial_" in plan_of(catalog.run(name, spark, folder)), name


def test_code_keeps_to_the_rules():
    for path in Path(entry.__file__).parent.rglob("buildlens/**/*.py"):
        text = path.read_text()
        # Models and totals of bounded size may come to the driver in the training-data part.
        bounded = () if "llm" in path.parts else (".collect()",)
        for word in ("localCheckpoint", ".toPandas(", "crossJoin", ".rdd", *bounded):
            assert word not in text, (path, word)


def test_every_query_has_sql():
    assert set(catalog.names()) == set(catalog.oracle_sql())
    assert set(catalog.names()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_hot_key_is_split_in_lookups(spark, folder):
    """The looked-up side has one row per key, and nothing is collected per key."""
    for name in ("j1_assign_task_ids", "j2_pending_builds", "j4_resolve_commit", "j8_attest"):
        plan = plan_of(catalog.run(name, spark, folder))
        assert "collect_list" not in plan and "collect_set" not in plan
        assert not re.search(r"Join.*FullOuter", plan), name


def test_site_values_are_parameters(rows):
    from buildlens.functions import refs
    from buildlens.site import Site

    site = Site(org="o", inner_org="oi", git_host="git@host")
    df = rows([("tikv",), ("tiem",), ("tidb",)], "r string")
    got = [r[0] for r in df.select(refs.git_remote(F.col("r"), site)).collect()]
    assert got == ["git@host:tikv/tikv.git", "git@host:oi/tiem.git", "git@host:o/tidb.git"]


def test_a_version_key_is_computed_once(spark, folder):
    plan = plan_of(catalog.run("f4_version_gate", spark, folder))
    assert plan.count("lambdafunction") <= 2, plan
