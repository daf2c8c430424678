"""Rows whose answers follow from the rules themselves."""

import pytest
from pyspark.sql import functions as F

from buildlens.functions import artifacts, refs, results, tasks, versions
from buildlens.operators import aggregates, joins, matrix
from buildlens.operators import tasks as task_ops
from buildlens.site import Site


def values(df, column):
    return [r[column] for r in df.collect()]


def apply(rows, inputs, kind, expression):
    """Results of an expression of ``c`` for each input, in order."""
    df = rows([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return values(df.withColumn("out", expression(F.col("c"))).orderBy("i"), "out")


def test_subtest_summary_counts_nulls_as_failed(rows):
    df = rows([("r", "success"), ("r", "failed"), ("r", None)], "run string, status string")
    assert values(aggregates.it_summary(df, ["run"]), "summary") == ["failed 2, success 1, total 3"]


def test_subtest_summary_of_nothing(rows):
    df = rows([(0, 0)], "success long, failed long")
    assert values(df.select(results.it_message(F.col("success"), F.col("failed")).alias("s")), "s") \
        == ["all 0 tests passed"]


def test_timeout_defaults(rows):
    assert apply(rows, [None, 1, 0, 2, 90], "int", tasks.default_timeout) == [60, 60, 60, 2, 90]


def test_retry_defaults(rows):
    assert apply(rows, [None, 11, 10, 0], "int", tasks.default_retry) == [0, 0, 10, 0]


def test_refs(rows):
    assert apply(rows, ["refs/heads/release-5.3", "master", "refs/heads/a/refs/heads/b"], "string",
                 refs.normalize_ref) == ["release-5.3", "master", "a/b"]


@pytest.mark.parametrize("statuses, outcome", [
    (["SUCCESS", "SKIPPED", "OMITTED"], "passed"), (["SUCCESS", "TIMEOUT"], "failed")])
def test_plan_outcome(rows, statuses, outcome):
    df = rows([(1, s) for s in statuses], "run int, status string")
    assert values(aggregates.plan_outcome(df, ["run"]), "outcome") == [outcome]


def test_toolchain(rows):
    cases = [("v5.1", ""), ("v5.1.1", ""), ("v6.0.0", ""), ("", "release-5.0"), ("", "release-5.4"),
             ("", "hz-poc"), ("", "master"), (None, None)]
    df = rows([(i, *c) for i, c in enumerate(cases)], "i int, tag string, branch string")
    tier = versions.toolchain_tier(F.col("tag"), F.col("branch"), F.lit("tidb"))
    assert values(df.withColumn("t", tier).orderBy("i"), "t") == [
        "1.13", "1.16", "1.18", "1.13", "1.16", "1.16", "1.18", "1.18"]


def test_release_tags(rows):
    assert apply(rows, ["release-5.4", "release-4.0-20210812", "master"], "string",
                 refs.release_tag_for_branch) == ["v5.4.0-nightly", "v4.0.0-nightly", "v6.1.0-nightly"]


@pytest.mark.parametrize("branch, tag, n", [
    ("release-5.4", "v5.4.0", 13), ("release-5.1", "v5.1.4", 24), ("release-5.0", "v5.0.6", 12)])
def test_prerelease_matrix(rows, branch, tag, n):
    assert matrix.prerelease_matrix(rows([(branch, tag)], "branch string, tag string")).count() == n


@pytest.mark.parametrize("branch, n", [("master", 17), ("release-5.3", 16), ("release-5.0", 14)])
def test_nightly_matrix(rows, branch, n):
    assert matrix.nightly_matrix(rows([(branch,)], "branch string")).count() == n


def test_small_matrices(rows):
    one = rows([(1,)], "x int")
    assert matrix.tiup_matrix(one).count() == 12
    assert matrix.arm_binary_matrix(one).count() == 4


def test_secret_vars(rows):
    got = apply(rows, ["id1:K1,bad,a:b:c,"], "string", tasks.decode_secret_vars)
    assert [(s.secretID, s.key) for s in got[0]] == [("id1", "K1")]


def test_substitution(rows):
    assert apply(rows, ["echo ${K} ${Z}"], "string",
                 lambda c: tasks.substitute_vars(c, F.array(F.lit("K")))) == ["echo $K ${Z}"]


def test_commit_status(rows):
    got = apply(rows, ["SUCCESS", "FAILURE", "ABORTED", None, "UNSTABLE"], "string",
                results.commit_status)
    assert [s.state for s in got] == ["success", "failure", "error", "error", "error"]


def test_versions_compare_as_text(rows):
    gate = lambda mode: lambda c: versions.version_gate(c, ">=", "v5.3.0", mode)
    assert apply(rows, ["v10.0.0", "v5.3.0", "v5.2.9"], "string", gate("lexical")) == [False, True, False]
    assert apply(rows, ["v10.0.0", "v5.3", "v5.2.9"], "string", gate("semantic")) == [True, True, False]


def test_hotfix_toolchain_keeps_the_dropped_letter(rows):
    strict = lambda c: versions.hotfix_toolchain(F.lit("tidb"), c)
    intended = lambda c: versions.hotfix_toolchain(F.lit("tidb"), c, strict_reference=False)
    assert apply(rows, ["v5.4.0-20220101"], "string", strict) == ["imagego1.13.7"]
    assert apply(rows, ["v5.4.0-20220101", "v5.1.0"], "string", intended) == [
        "imagego1.16.0", "imagego1.13.7"]


def test_resources_quirk(rows):
    schema = ("i int, c struct<limits:struct<memory:string,cpu:string>,"
              "requests:struct<memory:string,cpu:string>>")
    df = rows([
        (0, None), (1, {"limits": None, "requests": {"memory": "4Gi", "cpu": "2"}}),
        (2, {"limits": {"memory": "8Gi", "cpu": "4"}, "requests": {"memory": "4Gi", "cpu": "2"}}),
        (3, {"limits": {"memory": "8Gi", "cpu": "4"}, "requests": {"memory": "", "cpu": "2"}}),
    ], schema)
    got = values(df.withColumn("o", tasks.default_resources(F.col("c"))).orderBy("i"), "o")
    flat = [(r.limits.cpu, r.limits.memory, r.requests.cpu, r.requests.memory, r.requests_dropped)
            for r in got]
    assert flat == [("1000m", "2Gi", "1000m", "2Gi", False), ("2", "4Gi", None, None, True),
                    ("4", "8Gi", "2", "4Gi", False), ("1000m", "2Gi", "1000m", "2Gi", False)]


def test_split_repo(rows):
    got = apply(rows, ["a/b", "a/b/", "a", "a/b/c", "/b", None], "string", refs.split_repo)
    assert [(r.owner, r.repo) for r in got] == [
        ("a", "b"), ("a", "b"), ("", ""), ("", ""), ("", "b"), ("", "")]


def test_failures_by_class_name(rows):
    df = rows([
        (0, "org.jenkinsci.plugins.workflow.steps.FlowInterruptedException", None),
        (1, "hudson.AbortException", "script returned exit code 143"),
        (2, "hudson.AbortException", "script returned exit code 1"),
        (3, "java.lang.InterruptedException", "x"), (4, "java.lang.RuntimeException", "hasBeenCached"),
        (5, "java.lang.Exception", "boom"),
    ], "i int, c string, m string")
    for variant, first in (("job", "ABORTED"), ("merge", "FAILURE")):
        out = results.classify_failure(F.col("c"), F.col("m"), variant)
        assert values(df.withColumn("o", out).orderBy("i"), "o") == [
            first, "ABORTED", "FAILURE", "ABORTED", "SUCCESS", "FAILURE"]


def test_paths_read_back_with_slashes_in_the_branch(rows):
    path = artifacts.artifact_path(
        "single_image", product=F.lit("tiem"), commit=F.lit("c" * 40), version=F.col("c"),
        site=Site(org="other"))
    got = apply(rows, ["feature/sprint2/nightlyrun"], "string",
                lambda c: artifacts.parse_artifact_path(path))[0]
    assert (got.product, got.version, got.commit, got.arch) == (
        "tiem", "feature/sprint2/nightlyrun", "c" * 40, "amd64")
    assert apply(rows, ["nonsense"], "string", artifacts.parse_artifact_path)[0].layout is None


def test_receivers_keep_copies_unless_asked(rows):
    df = rows([(["x", "a"], "a", "t"), (None, "a", "t"), ([], "", "t")],
              "r array<string>, a string, t string")
    told = aggregates.notify_receivers(F.col("r"), F.col("a"), F.col("t"))
    assert values(df.select(told.alias("o")), "o") == [["x", "a", "a", "t"], None, ["t"]]
    unique = aggregates.notify_receivers(F.col("r"), F.col("a"), F.col("t"), unique=True)
    assert values(df.select(unique.alias("o")), "o") == [["x", "a", "t"], None, ["t"]]
    legacy = aggregates.notify_receivers(F.col("r"), F.col("a"), F.col("a"), flow="legacy")
    assert values(df.select(legacy.alias("o")), "o") == [["a"], ["a"], [""]]


def test_run_without_tasks_has_passed(rows):
    runs = rows([(1,), (2,), (3,)], "run_id int")
    tasks_ = rows([(1, "SUCCESS"), (1, None), (2, "SUCCESS")], "run_id int, result string")
    got = {r.run_id: (r.status, r.tasks) for r in aggregates.run_outcome(runs, tasks_).collect()}
    assert got == {1: ("failed", 2), 2: ("passed", 1), 3: ("passed", 0)}


def test_hotfix_is_one_nested_map(rows):
    import json

    df = rows([
        ("t", 1, "tidb", "amd64", "u1", "p1", "i1"), ("t", 2, "tidb", "arm64", "u2", "p2", "i2"),
        ("t", 3, "dm", "amd64", "u3", None, "i3")],
        "tag string, n int, product string, arch string, url string, patch_url string, image string")
    got = values(aggregates.assemble_hotfix(df, ["tag"], F.col("n")), "results")
    assert json.loads(got[0]) == {
        "dm": {"amd64": "u3", "image": "i3"},
        "tidb": {"amd64": "u1", "arm64": "u2", "image": "i2", "tiup-patch-amd64": "p2"}}


def test_only_scanned_images_are_reported(rows):
    images = artifacts.scanned_images()
    df = rows([(images[0], "HIGH"), (images[0], "LOW"), ("other", "HIGH")], "image string, severity string")
    got = aggregates.vulnerability_summary(df, ["image"], images=images).collect()
    assert [(r.image, r.high, r.low, r.total) for r in got] == [(images[0], 1, 1, 2)]


def test_missing_fields(rows):
    df = rows([("r", "p", "amd64", "linux", "", None, "", None)],
              "REPO string, PRODUCT string, ARCH string, OS string, GIT_HASH string, "
              "EDITION string, RELEASE_TAG string, TARGET_BRANCH string")
    assert values(df.select(task_ops.missing_fields().alias("m")), "m") == [
        ["GIT_HASH", "EDITION", "RELEASE_TAG|TARGET_BRANCH"]]


def test_special_head_ref(rows):
    heads = rows([("ng-monitoring", "main", "s1", 1), ("tidb", "master", "s2", 1),
                  ("tidb", "master", "s3", 2)], "repo string, ref string, sha string, seen int")
    asked = rows([("ng-monitoring", "master"), ("tidb", "master"), ("tidb", "none")],
                 "repo string, ref string")
    got = {(r.repo, r.ref): r.commit
           for r in joins.resolve_commit(asked, heads, F.col("seen")).collect()}
    assert got == {("ng-monitoring", "master"): "s1", ("tidb", "master"): "s3", ("tidb", "none"): None}


def test_last_rule_wins(rows):
    df = rows([("tikv", "amd64", "linux"), ("tics", "arm64", "linux"), ("tidb", "arm64", "linux"),
               ("pd", "arm64", "linux"), ("tics", "arm64", "darwin"), ("br", "amd64", "darwin"),
               ("br", "amd64", "linux")], "p string, a string, o string")
    host = joins.host_label(F.col("p"), F.col("a"), F.col("o"))
    assert values(df.select(host.alias("h")), "h") == [
        "build", "tiflash_build_arm", "go", "arm", "mac-arm-tiflash", "mac", "go"]


def test_unknown_arch_is_an_error_row(rows):
    got = matrix.expand_arch(rows([("both",), ("arm64",), ("riscv",), (None,)], "arch string"))
    assert sorted((r.arch or "", r.error or "") for r in got.collect()) == [
        ("", "unknown arch null"), ("", "unknown arch riscv"), ("amd64", ""), ("arm64", ""),
        ("arm64", "")]
