"""Queries for the joins."""

from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.operators import joins
from buildlens.plans.registry import Inputs, query


@query("j1_assign_task_ids", """
WITH created AS (SELECT run_id, task_type, arg_max(duration_ms, attempt) AS id FROM ci_attempts WHERE result <> 'FAILURE' GROUP BY 1, 2)
SELECT a.run_id, a.task_no, a.attempt, a.task_type AS taskName, c.id
FROM ci_attempts a LEFT JOIN created c ON a.run_id = c.run_id AND a.task_type = c.task_type
""")
def assign_task_ids(t: Inputs):
    tasks = t.view("ci_attempts").withColumnRenamed("task_type", "taskName")
    created = tasks.filter(F.col("result") != "FAILURE").select(
        "run_id", "taskName", F.col("duration_ms").alias("id"), F.col("attempt").alias("position"))
    return joins.assign_task_ids(
        tasks.select("run_id", "task_no", "attempt", "taskName"), created)


def _requests(t: Inputs):
    return t.view("branches").select(
        "run_id", "product", "tag", (F.col("run_id") % 10 == 0).alias("force"))


@query("j2_pending_builds", """
SELECT run_id, product, tag, run_id % 10 = 0 AS force FROM branches b
WHERE run_id % 10 = 0 OR NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.product = b.product AND a.tag = b.tag)
""")
def pending_builds(t: Inputs):
    return joins.pending_builds(_requests(t), t.view("artifacts"), ["product", "tag"])


@query("j3_existing_builds", """
SELECT run_id, product, tag, run_id % 10 = 0 AS force FROM branches b
WHERE run_id % 10 <> 0 AND EXISTS (SELECT 1 FROM artifacts a WHERE a.product = b.product AND a.tag = b.tag)
""")
def existing_builds(t: Inputs):
    return joins.existing_builds(_requests(t), t.view("artifacts"), ["product", "tag"])


@query("j4_resolve_commit", """
WITH latest AS (SELECT repo, ref, arg_max(sha, seen) AS sha FROM heads GROUP BY 1, 2)
SELECT b.run_id, b.product AS repo, b.branch AS ref, l.sha AS commit
FROM branches b LEFT JOIN latest l ON l.repo = b.product AND l.ref = b.branch
""")
def resolve_commit(t: Inputs):
    requests = t.view("branches").select(
        "run_id", F.col("product").alias("repo"), F.col("branch").alias("ref"))
    return joins.resolve_commit(requests, t.view("heads"), F.col("seen"))


@query("j5_resolve_commit_asof", """
WITH points AS (SELECT repo, ts, arg_max(sha, seen) AS sha FROM commit_log GROUP BY 1, 2)
SELECT b.run_id, b.product AS repo, b.start_ts AS ts, p.sha AS commit
FROM branches b ASOF LEFT JOIN points p ON b.product = p.repo AND b.start_ts >= p.ts
""")
def resolve_commit_asof(t: Inputs):
    requests = t.view("branches").select(
        "run_id", F.col("product").alias("repo"), F.col("start_ts").alias("ts"))
    return joins.resolve_commit_asof(
        requests, t.view("commit_log"), ["repo"], "ts", tie="seen", seconds=90 * 86_400)


@query("j6_effective_repo", """
SELECT run_id,
  CASE WHEN product = 'br' AND (branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.2')) THEN 'tidb'
       WHEN product = 'dumpling' AND (branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.3')) THEN 'tidb'
       WHEN product IN ('ticdc', 'dm') THEN 'tiflow'
       WHEN product = 'tidb-lightning' THEN CASE WHEN branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.2') THEN 'tidb' ELSE 'br' END
       ELSE product END AS nightly,
  CASE WHEN product = 'br' AND tag >= 'v5.2.0' THEN 'tidb' WHEN product = 'dumpling' AND tag >= 'v5.3.0' THEN 'tidb'
       WHEN product = 'ticdc' THEN 'tiflow' ELSE product END AS pre_release,
  CASE WHEN product = 'br' AND (branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.2')) THEN 'tidb'
       ELSE product END AS single_image
FROM branches
""")
def effective_repo(t: Inputs):
    p, b, g = F.col("product"), F.col("branch"), F.col("tag")
    return t.view("branches").select(
        "run_id", joins.effective_repo(p, b, "nightly").alias("nightly"),
        joins.effective_repo(p, g, "pre_release").alias("pre_release"),
        joins.effective_repo(p, b, "single_image").alias("single_image"))


_DM = "CASE WHEN product = 'tics' AND failpoint THEN 'dm' ELSE product END"


@query("j6_moves_table", """
WITH moves AS (SELECT product, from_ref, max(concat(to_ref, '|', repo)) AS m FROM (
  SELECT product, tag AS from_ref, concat(tag, CASE CAST(artifact_id % 3 AS INT) WHEN 0 THEN '' ELSE '.5' END) AS to_ref, concat('moved-', product) AS repo FROM artifacts) x GROUP BY 1, 2)
SELECT b.run_id, CASE WHEN b.tag < split_part(m.m, '|', 1) THEN split_part(m.m, '|', 2) ELSE b.product END AS repo
FROM branches b ASOF LEFT JOIN moves m ON b.product = m.product AND b.tag >= m.from_ref
""")
def moves_table(t: Inputs):
    end = F.concat(F.col("tag"), F.when(F.col("artifact_id") % 3 == 0, "").otherwise(".5"))
    moves = t.view("artifacts").select(
        "product", F.col("tag").alias("from_ref"), end.alias("to_ref"), F.concat(F.lit("moved-"), "product").alias("repo"))
    requests = t.view("branches").select("run_id", "product", F.col("tag").alias("ref"))
    return joins.moved_repo(requests, moves).select("run_id", "repo")


@query("j7_expected_binaries", f"""
WITH images AS (SELECT artifact_id, {_DM} AS product, tag FROM image_versions),
listed AS (SELECT *, CASE product WHEN 'pd' THEN ['/pd-server'] WHEN 'tikv' THEN ['/tikv-server'] WHEN 'tidb' THEN ['/tidb-server']
    WHEN 'br' THEN ['/br'] WHEN 'dumpling' THEN ['/dumpling'] WHEN 'tidb-binlog' THEN ['/pump', '/drainer'] WHEN 'ticdc' THEN ['/cdc']
    WHEN 'tidb-lightning' THEN CASE WHEN replace(tag, 'v', '') >= '5.2.0' THEN ['/tidb-lightning', '/br'] ELSE ['/tidb-lightning', '/tikv-importer', '/br'] END
    WHEN 'dm' THEN CASE WHEN tag >= 'v5.3.0' THEN ['/dm-master', '/dm-worker', '/dmctl'] END END AS b FROM images)
SELECT artifact_id, product, tag, unnest(b) AS binary FROM listed
""")
def expected_binaries(t: Inputs):
    images = t.view("image_versions").select("artifact_id", F.expr(_DM).alias("product"), "tag")
    return joins.expected_binaries(images)


@query("j8_attest", """
WITH w AS (SELECT artifact_id, commit, replace(tag, 'v', '') AS tag FROM wanted_builds WHERE contains(tag, 'nightly') OR contains(tag, 'alpha')),
f AS (SELECT artifact_id, commit, regexp_replace(tag, 'v', '') AS tag FROM found_builds WHERE contains(tag, 'nightly') OR contains(tag, 'alpha'))
SELECT COALESCE(w.artifact_id, f.artifact_id) AS artifact_id, w.commit AS commit_expected, f.commit AS commit_actual,
  w.tag AS tag_expected, f.tag AS tag_actual,
  CASE WHEN w.artifact_id IS NULL THEN 'unexpected' WHEN f.artifact_id IS NULL THEN 'missing'
       WHEN w.commit IS NOT DISTINCT FROM f.commit AND w.tag IS NOT DISTINCT FROM f.tag THEN 'pass' ELSE 'fail' END AS status
FROM w FULL OUTER JOIN f ON w.artifact_id = f.artifact_id
""")
def attest(t: Inputs):
    return joins.attest(t.view("wanted_builds"), t.view("found_builds"), ["artifact_id"])


_IMAGE = "concat(product, ':', tag, '-linux-', arch, '@', CAST(artifact_id AS STRING))"


@query("j9_multiarch_manifest", f"""
SELECT product, tag, arm64_image, amd64_image, concat(arm64_image, ' ', amd64_image) AS manifests FROM (
  SELECT product, tag, arg_max({_IMAGE}, artifact_id) FILTER (WHERE arch = 'arm64') AS arm64_image,
         arg_max({_IMAGE}, artifact_id) FILTER (WHERE arch = 'amd64') AS amd64_image
  FROM artifacts GROUP BY 1, 2) m
WHERE arm64_image IS NOT NULL AND amd64_image IS NOT NULL
""")
def multiarch_manifest(t: Inputs):
    images = t.view("artifacts").withColumn("image", F.expr(_IMAGE))
    pairs = joins.multiarch_manifest(images, ["product", "tag"], "image", F.col("artifact_id"))
    return pairs.withColumn("manifests", F.array_join("manifests", " "))


@query("j10_images_to_sync", """
SELECT artifact_id, product, tag FROM artifacts s
WHERE NOT EXISTS (SELECT 1 FROM artifacts x WHERE x.arch = 'amd64' AND x.product = s.product AND x.tag = s.tag AND x.sha = s.sha)
""")
def images_to_sync(t: Inputs):
    images = t.view("artifacts")
    there = images.filter(F.col("arch") == "amd64")
    return joins.images_to_sync(images, there, ["product", "tag", "sha"]).select(
        "artifact_id", "product", "tag")


@query("j11_patch_targets", """
SELECT artifact_id, product, CASE product WHEN 'tidb' THEN 'tidb-server' WHEN 'tikv' THEN 'tikv-server'
  WHEN 'ticdc' THEN 'cdc' WHEN 'pd' THEN 'pd-server' END AS patch_binaries
FROM artifacts WHERE product IN ('tikv', 'tidb', 'pd', 'ticdc')
""")
def patch_targets(t: Inputs):
    return joins.patch_targets(t.view("artifacts")).select("artifact_id", "product", "patch_binaries")


_RULES = ", ".join(
    f"({i}, [{', '.join(repr(p) for p in products)}]::VARCHAR[], '{arch}', '{os}', '{label}')"
    for i, (products, arch, os, label) in enumerate(fixed.HOST_RULES))


@query("j12_last_matching_rule", f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) AS r(rule_no, products, arch, os, label)),
builds AS (SELECT artifact_id, product, arch, CASE WHEN artifact_id % 3 = 0 THEN 'darwin' ELSE 'linux' END AS os FROM artifacts)
SELECT b.artifact_id, arg_max(r.label, r.rule_no) AS host FROM builds b JOIN rules r
  ON (len(r.products) = 0 OR list_contains(r.products, b.product)) AND (r.arch = '' OR r.arch = b.arch) AND (r.os = '' OR r.os = b.os)
GROUP BY 1
""")
def last_matching_rule(t: Inputs):
    os = F.when(F.col("artifact_id") % 3 == 0, "darwin").otherwise("linux")
    return t.view("artifacts").select(
        "artifact_id", joins.host_label(F.col("product"), F.col("arch"), os).alias("host"))


@query("j12_rules_table", """
WITH rules AS (SELECT c_custkey AS rule_no, c_name AS label, CASE CAST(c_nationkey % 5 AS INT) WHEN 0 THEN [] WHEN 1 THEN ['tikv', 'pd'] WHEN 2 THEN ['tidb'] WHEN 3 THEN ['tics', 'br', 'ticdc'] END AS products,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'arm64' WHEN 'MACHINERY' THEN 'amd64' WHEN 'FURNITURE' THEN '' END AS arch,
  CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'darwin' WHEN 2 THEN 'plan9' ELSE 'linux' END AS os FROM customer WHERE c_acctbal < 0),
builds AS (SELECT artifact_id, product, arch, CASE WHEN artifact_id % 3 = 0 THEN 'darwin' WHEN artifact_id % 7 <> 0 THEN 'linux' END AS os FROM artifacts)
SELECT b.artifact_id, arg_max(r.label, r.rule_no) AS host FROM builds b LEFT JOIN rules r
  ON (coalesce(len(r.products), 0) = 0 OR list_contains(r.products, b.product)) AND (coalesce(r.arch, '') = '' OR r.arch = b.arch) AND (r.os = '' OR r.os = b.os)
GROUP BY 1
""")
def rules_table(t: Inputs):
    none = F.array().cast("array<string>")
    nation, key = F.col("c_nationkey") % 5, F.col("c_custkey") % 7
    rules = t.table("customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("rule_no"), F.col("c_name").alias("label"),
        F.when(nation == 0, none).when(nation == 1, F.array(F.lit("tikv"), F.lit("pd")))
        .when(nation == 2, F.array(F.lit("tidb")))
        .when(nation == 3, F.array(F.lit("tics"), F.lit("br"), F.lit("ticdc"))).alias("products"),
        F.when(F.col("c_mktsegment") == "BUILDING", "arm64").when(F.col("c_mktsegment") == "MACHINERY", "amd64")
        .when(F.col("c_mktsegment") == "FURNITURE", "").alias("arch"),
        F.when(key == 0, "").when(key == 1, "darwin").when(key == 2, "plan9").otherwise("linux").alias("os"))
    os = F.when(F.col("artifact_id") % 3 == 0, "darwin").when(F.col("artifact_id") % 7 != 0, "linux")
    builds = t.view("artifacts").select("artifact_id", "product", "arch", os.alias("os"))
    return joins.last_matching_rule(builds, rules).select("artifact_id", "host")


@query("j13_lint_config_present", """
WITH listing AS (SELECT DISTINCT product AS repo, concat(product, '.yaml') AS config FROM artifacts WHERE product LIKE 't%')
SELECT r.run_id, r.product AS repo, COALESCE(l.config, 'default') AS config
FROM ci_runs r LEFT JOIN listing l ON l.repo = r.product
""")
def lint_config_present(t: Inputs):
    listing = t.view("artifacts").filter(F.col("product").startswith("t")).select(
        F.col("product").alias("repo"), F.concat("product", F.lit(".yaml")).alias("config"))
    repos = t.view("ci_runs").select("run_id", F.col("product").alias("repo"))
    return joins.lint_config_present(repos, listing)


@query("j14_plan_executions", """
WITH plans AS (SELECT concat('plan-', CAST(o_custkey AS STRING)) AS name, min(o_orderkey) AS plan_id FROM orders GROUP BY 1),
execs AS (SELECT l_orderkey * 10 AS trigger_id, min(l_partkey) AS exec_id FROM lineitem GROUP BY 1)
SELECT concat('plan-', CAST(c.c_custkey AS STRING)) AS name, p.plan_id, p.plan_id * 10 AS trigger_id, e.exec_id
FROM customer c JOIN plans p ON p.name = concat('plan-', CAST(c.c_custkey AS STRING)) JOIN execs e ON e.trigger_id = p.plan_id * 10
""")
def plan_executions(t: Inputs):
    def name(key: str):
        return F.concat(F.lit("plan-"), F.col(key).cast("string"))

    orders = t.table("orders")
    return joins.plan_executions(
        t.table("customer").select(name("c_custkey").alias("name")),
        orders.select(name("o_custkey").alias("query"), F.col("o_orderkey").alias("plan_id")),
        orders.select(name("o_custkey").alias("name"), F.col("o_orderkey").alias("plan_id"),
                      (F.col("o_orderkey") * 10).alias("trigger_id")),
        t.table("lineitem").select((F.col("l_orderkey") * 10).alias("trigger_id"),
                                   F.col("l_partkey").alias("exec_id")))


_MONITORING = "CASE WHEN product = 'tics' THEN 'monitoring' ELSE product END"


@query("j15_apply_overrides", f"""
WITH requests AS (SELECT run_id, {_MONITORING} AS product, branch, tag, author AS commit FROM branches),
given AS (SELECT product, max(CASE WHEN product = 'tikv' THEN sha END) AS commit,
                 max(CASE WHEN product IN ('tikv', 'pd') AND artifact_id > 9 THEN CAST(artifact_id AS STRING) END) AS pr
          FROM artifacts GROUP BY 1)
SELECT r.run_id, r.product, r.branch, CASE WHEN r.product = 'monitoring' THEN r.branch ELSE r.tag END AS tag,
       COALESCE(g.commit, r.commit) AS commit, g.pr AS pull_request
FROM requests r LEFT JOIN given g ON g.product = r.product
""")
def apply_overrides(t: Inputs):
    requests = t.view("branches").select(
        "run_id", F.expr(_MONITORING).alias("product"), "branch", "tag",
        F.col("author").alias("commit"))
    product = F.col("product")
    overrides = t.view("artifacts").select(
        "product", F.when(product == "tikv", F.col("sha")).otherwise("-").alias("commit"),
        F.when(product.isin("tikv", "pd"), F.col("artifact_id").cast("string")).otherwise("")
        .alias("pull_request"))
    return joins.apply_overrides(requests, overrides)
