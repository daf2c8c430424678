"""Queries for filters and one-to-many rows."""

from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.functions import versions
from buildlens.operators import filters, matrix
from buildlens.plans.registry import Inputs, query


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("f1_valid_commit", """
SELECT artifact_id, length(sha) = 40 AS valid FROM artifacts
""")
def valid_commit(t: Inputs):
    good, bad = filters.split_valid_commits(t.view("artifacts"))
    return good.select("artifact_id", F.lit(True).alias("valid")).unionByName(
        bad.select("artifact_id", F.lit(False).alias("valid")))


@query("f2_valid_hotfix_tag", """
SELECT artifact_id, starts_with(t, 'v') AND contains(t, '-202') AS valid
FROM (SELECT *, concat(CASE WHEN debug THEN '' ELSE tag END, CASE WHEN failpoint THEN '-20210221' ELSE '-1' END) AS t FROM image_versions) i
""")
def valid_hotfix_tag(t: Inputs):
    tag = F.concat(F.when(F.col("debug"), "").otherwise(F.col("tag")),
                   F.when(F.col("failpoint"), "-20210221").otherwise("-1"))
    return t.view("image_versions").select(
        "artifact_id", versions.valid_hotfix_tag(tag).alias("valid"))


@query("f3_is_prerelease", """
SELECT artifact_id, contains(t, 'nightly') OR contains(t, 'alpha') AS prerelease
FROM (SELECT artifact_id, concat(tag, CASE artifact_id % 3 WHEN 0 THEN '-nightly' WHEN 1 THEN '-alpha.1' ELSE '' END) AS t FROM artifacts) a
""")
def is_prerelease(t: Inputs):
    kind = F.col("artifact_id") % 3
    tag = F.concat("tag", F.when(kind == 0, "-nightly").when(kind == 1, "-alpha.1").otherwise(""))
    return t.view("artifacts").select("artifact_id", versions.is_prerelease(tag).alias("prerelease"))


@query("f4_version_gate", r"""
WITH tagged AS (
  SELECT run_id, tag FROM branches
  UNION ALL SELECT run_id, concat(tag, '-', CAST(20220505101112 + run_id AS STRING)) FROM branches
  UNION ALL SELECT run_id, concat(tag, '.0.0.1.', CAST(run_id % 3 AS STRING)) FROM branches),
keyed AS (
  SELECT run_id, tag, list_transform(list_concat(regexp_extract_all(tag, '\d+'), list_transform(range(9), lambda i: '0')),
                                     lambda x: CAST(x AS HUGEINT))[1:9] AS k
  FROM tagged)
SELECT run_id, tag, tag >= 'v5.3.0' AS lexical, tag <= 'v5.1' AS lexical_old,
       k >= [5, 3, 0, 0, 0, 0, 0, 0, 0]::HUGEINT[] AS semantic, k <= [5, 1, 0, 0, 0, 0, 0, 0, 0]::HUGEINT[] AS semantic_old,
       k > [5, 3, 0, 999999999, 0, 0, 0, 0, 0]::HUGEINT[] AS after_a_build
FROM keyed
""")
def version_gate(t: Inputs):
    tag, run = F.col("tag"), F.col("run_id")
    tags = F.array(
        tag, F.concat(tag, F.lit("-"), (run + 20220505101112).cast("string")),
        F.concat(tag, F.lit(".0.0.1."), (run % 3).cast("string")))
    key = F.col("key")
    return t.view("branches").select("run_id", F.explode(tags).alias("tag")) \
        .withColumn("key", versions.semantic_key(tag)).select(
        "run_id", "tag",
        versions.version_gate(tag, ">=", "v5.3.0").alias("lexical"),
        versions.version_gate(tag, "<=", "v5.1").alias("lexical_old"),
        versions.version_gate(key, ">=", "v5.3.0", mode="key").alias("semantic"),
        versions.version_gate(key, "<=", "v5.1", mode="key").alias("semantic_old"),
        versions.version_gate(key, ">", "v5.3.0-999999999", mode="key").alias("after_a_build"))


@query("f5_severity_filter", """
SELECT vuln_id, image, severity FROM vulnerabilities WHERE severity IN ('HIGH', 'CRITICAL')
""")
def severity_filter(t: Inputs):
    return filters.severity_filter(t.view("vulnerabilities"))


@query("f6_exclude_rules", f"""
SELECT run_id, rule_id, file_id FROM findings WHERE rule_id NOT IN ({_list(fixed.EXCLUDED_RULES)})
""")
def exclude_rules(t: Inputs):
    return filters.exclude_rules(t.view("findings"))


@query("f7_notify_filter", """
SELECT 'current' AS flow, run_id, result FROM outcomes WHERE policy = 'always' OR result = 'FAILURE'
UNION ALL SELECT 'legacy_verify', run_id, result FROM outcomes WHERE policy = 'IfPipelineFail' AND result = 'FAILURE'
UNION ALL SELECT 'legacy_daily', run_id, result FROM outcomes WHERE result = 'FAILURE'
""")
def notify_filter(t: Inputs):
    flows = F.array(*[
        F.when(filters.should_notify(F.col("result"), F.col("policy"), flow), F.lit(flow))
        for flow in ("current", "legacy_verify", "legacy_daily")])
    return t.view("outcomes").select(
        F.explode(F.array_compact(flows)).alias("flow"), "run_id", "result")


_EVENT_TYPES = " OR ".join(
    f"(trigger_event = '{e}' AND task_type IN ({_list(types)}))"
    for e, types in fixed.TASK_TYPES.items())
_TYPED = "SELECT a.*, r.trigger_event FROM ci_attempts a JOIN ci_runs r ON a.run_id = r.run_id"


def typed_tasks(t: Inputs):
    events = t.view("ci_runs").select("run_id", "trigger_event")
    return t.view("ci_attempts").join(events, "run_id")


@query("f8_known_task_types", f"""
SELECT run_id, task_no, attempt, task_type, trigger_event FROM ({_TYPED}) x WHERE {_EVENT_TYPES}
""")
def known_task_types(t: Inputs):
    return filters.known_task_types(typed_tasks(t), F.col("trigger_event")).select(
        "run_id", "task_no", "attempt", "task_type", "trigger_event")


@query("f8_dropped_task_types", f"""
SELECT trigger_event, task_type, count(*) AS dropped FROM ({_TYPED}) x WHERE NOT ({_EVENT_TYPES}) GROUP BY 1, 2
""")
def dropped_task_types(t: Inputs):
    return filters.dropped_task_types(typed_tasks(t), F.col("trigger_event"))


@query("f9_failed_attempts", """
SELECT run_id, task_no, attempt, shown FROM (SELECT *, CASE WHEN result <> 'UNSTABLE' THEN result END AS shown FROM ci_attempts) a
WHERE shown IS DISTINCT FROM 'SUCCESS'
""")
def failed_attempts(t: Inputs):
    shown = F.when(F.col("result") != "UNSTABLE", F.col("result"))
    return filters.failed_attempts(t.view("ci_attempts").withColumn("result", shown)).select(
        "run_id", "task_no", "attempt", F.col("result").alias("shown"))


@query("f10_branch_filter", """
SELECT case_id, suite, branch, outcome FROM test_cases WHERE branch = 'en'
""")
def branch_filter(t: Inputs):
    return filters.branch_filter(t.view("test_cases"), "en").select(
        "case_id", "suite", "branch", "outcome")


@query("f11_buildable", f"""
SELECT run_id, product, product IN ({_list(fixed.BUILDABLE_PRODUCTS)}) AS buildable FROM ci_runs
""")
def buildable(t: Inputs):
    good, rejected = filters.split_buildable(t.view("ci_runs"))
    return good.select("run_id", "product", F.lit(True).alias("buildable")).unionByName(
        rejected.select("run_id", "product", F.lit(False).alias("buildable")))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(
        f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in rows)


_PRE = [(p, "amd64", False) for p in fixed.PRERELEASE_PRODUCTS]
_PRE_FAIL = [(p, "amd64", True) for p in fixed.PRERELEASE_FAILPOINT]
_PRE_ARM = [(p, "arm64", f) for p, _, f in _PRE + _PRE_FAIL]


@query("x1_prerelease_matrix", f"""
WITH asked AS (SELECT DISTINCT CASE WHEN branch = 'release-5.0' THEN 'release-5.1' ELSE branch END AS branch, tag FROM branches)
SELECT a.branch, a.tag, m.product, m.arch, m.failpoint FROM asked a
JOIN (VALUES {_values(_PRE + _PRE_FAIL)}) AS m(product, arch, failpoint) ON true
UNION ALL SELECT branch, tag, 'ng-monitoring', 'amd64', false FROM asked WHERE tag >= 'v5.3.0'
UNION ALL SELECT a.branch, a.tag, m.product, m.arch, m.failpoint FROM asked a
JOIN (VALUES {_values(_PRE_ARM)}) AS m(product, arch, failpoint) ON a.branch = 'release-5.1'
""")
def prerelease_matrix(t: Inputs):
    branch = F.when(F.col("branch") == "release-5.0", "release-5.1").otherwise(F.col("branch"))
    return matrix.prerelease_matrix(
        t.view("branches").select(branch.alias("branch"), "tag").distinct())


_NIGHT = [(f"{p}-multi-arch", p, "normal", True) for p in fixed.NIGHTLY_PRODUCTS]
_NIGHT_NEW = [("dm-multi-arch", "dm", "normal", True),
              ("ng-monitoring-multi-arch", "ng-monitoring", "normal", False)]
_NIGHT_FAIL = [(f"{p}-failpoint", p, "failpoint", False) for p in fixed.NIGHTLY_FAILPOINT]
_NIGHT_ALWAYS = [("tics-build", "tics", "normal", False)] + _NIGHT + _NIGHT_FAIL


@query("x2_nightly_matrix", f"""
WITH asked AS (SELECT DISTINCT branch FROM branches)
SELECT branch, stage, product, kind, debug FROM asked
JOIN (VALUES {_values(_NIGHT_ALWAYS)}) AS m(stage, product, kind, debug) ON true
UNION ALL SELECT branch, stage, product, kind, debug FROM asked
JOIN (VALUES {_values(_NIGHT_NEW)}) AS m(stage, product, kind, debug) ON branch >= 'release-5.3' OR branch = 'master'
UNION ALL SELECT branch, 'monitoring', 'monitoring', 'monitoring', false FROM asked WHERE branch = 'master'
""")
def nightly_matrix(t: Inputs):
    return matrix.nightly_matrix(t.view("branches").select("branch").distinct())


@query("x3_tiup_matrix", f"""
WITH asked AS (SELECT DISTINCT tag FROM branches)
SELECT 'tiup' AS kind, tag, product, platform FROM asked,
  (SELECT unnest([{_list(fixed.TIUP_PRODUCTS)}]) AS product) p, (SELECT unnest([{_list(fixed.TIUP_PLATFORMS)}]) AS platform) q
UNION ALL SELECT 'arm', tag, product, 'linux-arm64' FROM asked,
  (SELECT unnest([{_list(fixed.ARM_BINARY_PRODUCTS)}]) AS product) p
""")
def tiup_matrix(t: Inputs):
    asked = t.view("branches").select("tag").distinct()
    tiup = matrix.tiup_matrix(asked.withColumn("kind", F.lit("tiup")))
    return tiup.unionByName(matrix.arm_binary_matrix(asked.withColumn("kind", F.lit("arm"))))


@query("x4_expand_arch", """
WITH asked AS (SELECT artifact_id, CASE artifact_id % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'riscv' ELSE arch END AS arch FROM artifacts)
SELECT artifact_id, arch, CAST(NULL AS STRING) AS error FROM asked WHERE arch IN ('amd64', 'arm64')
UNION ALL SELECT artifact_id, unnest(['amd64', 'arm64']), NULL FROM asked WHERE arch = 'both'
UNION ALL SELECT artifact_id, NULL, concat('unknown arch ', arch) FROM asked WHERE arch NOT IN ('both', 'amd64', 'arm64')
""")
def expand_arch(t: Inputs):
    kind = F.col("artifact_id") % 5
    arch = F.when(kind == 0, "both").when(kind == 1, "riscv").otherwise(F.col("arch"))
    return matrix.expand_arch(t.view("artifacts").select("artifact_id", arch.alias("arch")))


_BINARIES = "concat(product, '-server,', CASE WHEN debug THEN '' ELSE concat(product, '-ctl') END, CASE WHEN failpoint THEN ',,' ELSE '' END)"


@query("x5_explode_csv", f"""
SELECT artifact_id, unnest(str_split(rtrim({_BINARIES}, ','), ',')) AS item FROM image_versions
""")
def explode_csv(t: Inputs):
    df = t.view("image_versions").select("artifact_id", F.expr(_BINARIES).alias("items"))
    return matrix.explode_csv(df, "items", "item").select("artifact_id", "item")


_IMAGES = ("concat(CASE artifact_id % 3 WHEN 0 THEN 'acme/' WHEN 1 THEN 'hub.acme.example/qa/' ELSE 'elsewhere/' END, product, ':', tag, "
           "CASE WHEN debug THEN concat(',mirror.acme.example/', product, ':', tag) ELSE '' END)")


@query("x6_route_images", f"""
WITH items AS (SELECT artifact_id, unnest(str_split({_IMAGES}, ',')) AS image FROM image_versions)
SELECT artifact_id, image, 'push' AS action, CAST(NULL AS STRING) AS source, concat('hub.acme.example/image-sync/', image) AS target FROM items WHERE starts_with(image, 'acme/')
UNION ALL SELECT artifact_id, image, 'sync', concat('hub.acme.example/image-sync/', image), image FROM items WHERE starts_with(image, 'acme/')
UNION ALL SELECT artifact_id, image, 'push', NULL, image FROM items WHERE starts_with(image, 'hub.acme.example/') OR starts_with(image, 'mirror.acme.example/')
""")
def route_images(t: Inputs):
    df = t.view("image_versions").select("artifact_id", F.expr(_IMAGES).alias("images"))
    return matrix.route_images(df).drop("images")


@query("x7_missed_runs", """
WITH spans AS (SELECT product, branch, min(CAST(start_ts AS DATE)) AS first, max(CAST(start_ts AS DATE)) AS last
               FROM branches GROUP BY 1, 2),
days AS (SELECT product, branch, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM spans)
SELECT d.product, d.branch, d.day FROM days d
WHERE NOT EXISTS (SELECT 1 FROM branches b WHERE b.product = d.product AND b.branch = d.branch AND CAST(b.start_ts AS DATE) = d.day)
""")
def missed_runs(t: Inputs):
    runs = t.view("branches").select("product", "branch", F.to_date("start_ts").alias("day"))
    spans = runs.groupBy("product", "branch").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    expected = matrix.expected_runs(spans, F.col("first"), F.col("last"))
    return matrix.missed_runs(expected, runs, ["product", "branch", "day"]).drop("first", "last")
