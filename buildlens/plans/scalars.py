"""Queries for the column expressions."""

from pyspark.sql import functions as F

from buildlens.functions import artifacts, refs, results, tasks, versions
from buildlens.operators import joins
from buildlens.operators import tasks as task_ops
from buildlens.plans.registry import Inputs, query
from buildlens.site import DEFAULT_SITE as SITE


@query("p1_split_repo", """
WITH parts AS (SELECT run_id, name, str_split(rtrim(name, '/'), '/') AS p FROM repo_names)
SELECT run_id, CASE WHEN len(p) = 2 THEN p[1] ELSE '' END AS owner,
       CASE WHEN len(p) = 2 THEN p[2] ELSE '' END AS repo,
       CASE WHEN len(p) = 2 THEN p[1] END AS owner_kept,
       CASE WHEN len(p) = 2 THEN p[2] ELSE name END AS repo_kept
FROM parts
""")
def split_repo(t: Inputs):
    name = F.col("name")
    return t.view("repo_names").select(
        "run_id", refs.split_repo(name).alias("a"), refs.split_repo(name, "keep").alias("b")
    ).select("run_id", "a.owner", "a.repo", F.col("b.owner").alias("owner_kept"),
             F.col("b.repo").alias("repo_kept"))


@query("p2_normalize_ref", """
SELECT run_id, CASE WHEN starts_with(ref, 'refs/heads/') THEN replace(ref, 'refs/heads/', '')
                    ELSE ref END AS branch
FROM ci_runs
""")
def normalize_ref(t: Inputs):
    return t.view("ci_runs").select("run_id", refs.normalize_ref(F.col("ref")).alias("branch"))


@query("p3_resolve_trigger", """
SELECT run_id, COALESCE(NULLIF(trigger_author, ''), author) AS told,
       CASE WHEN trigger_author = '' THEN author ELSE trigger_author END AS told_legacy
FROM ci_runs
""")
def resolve_trigger(t: Inputs):
    a, b = F.col("trigger_author"), F.col("author")
    return t.view("ci_runs").select(
        "run_id", refs.resolve_trigger(a, b).alias("told"),
        refs.resolve_trigger(a, b, legacy=True).alias("told_legacy"))


PATHS_SQL = """
SELECT artifact_id, product, arch, tag, sha, branch, failpoint, debug,
  concat('builds/acme/devops/cachecode/', product, '/', sha, '/', product, '.tar.gz') AS code_cache,
  concat('builds/acme/devops/atom-build/', product, '/', sha, '/', product, '.tar.gz') AS atom_build,
  concat('builds/hotfix', CASE WHEN debug THEN '-debug' ELSE '' END, '/', product, '/', tag, '/', sha,
         '/centos7/', product, '-linux-', arch, '.tar.gz') AS hotfix,
  concat('builds/hotfix', CASE WHEN debug THEN '-debug' ELSE '' END, '/', product, '/', tag, '/', sha,
         '/centos7/', product, '-patch-linux-', arch, '.tar.gz') AS hotfix_patch,
  concat('builds/acme/qa-daily-image-build/', packed, '/', branch, '/', sha, '/centos7/', packed,
         '-linux-', arch, CASE WHEN failpoint THEN '-failpoint' ELSE '' END, '.tar.gz') AS nightly,
  concat('builds/acme/', product, '/test/', CASE WHEN failpoint THEN 'failpoint/' ELSE '' END, tag, '/',
         sha, '/linux-', arch, '/', product, '.tar.gz') AS pre_release,
  concat('builds/acme/', product, '/test/', branch, '/', sha, '/linux-amd64/', product, '.tar.gz') AS single_image,
  concat('builds/acme/', product, '/test/', sha, '/linux-arm64/', product, '.tar.gz') AS arm_test
FROM (SELECT *, CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END AS packed FROM image_versions) v
"""


def stored_paths(t: Inputs):
    df = t.view("image_versions")

    def path(kind: str, version: str = "tag"):
        return artifacts.artifact_path(
            kind, product=F.col("product"), commit=F.col("sha"), version=F.col(version),
            arch=F.col("arch"), failpoint=F.col("failpoint"), debug=F.col("debug"),
        ).alias(kind)

    return df.select(
        "*", path("code_cache"), path("atom_build"), path("hotfix"), path("hotfix_patch"),
        path("nightly", "branch"), path("pre_release"), path("single_image", "branch"),
        path("arm_test"))


query("p4_artifact_path", PATHS_SQL)(stored_paths)

_KINDS = ["code_cache", "atom_build", "hotfix", "hotfix_patch", "nightly", "pre_release",
          "single_image", "arm_test"]


@query("p5_parse_artifact_path", """
SELECT artifact_id, 'code_cache' AS kind, 'code_cache' AS layout, product, NULL AS version, sha AS commit, NULL AS os, NULL AS arch, false AS failpoint, false AS debug, false AS patch FROM image_versions
UNION ALL SELECT artifact_id, 'atom_build', 'atom_build', product, NULL, sha, NULL, NULL, false, false, false FROM image_versions
UNION ALL SELECT artifact_id, 'hotfix', 'hotfix', product, tag, sha, 'linux', arch, false, debug, false FROM image_versions
UNION ALL SELECT artifact_id, 'hotfix_patch', 'hotfix', product, tag, sha, 'linux', arch, false, debug, true FROM image_versions
UNION ALL SELECT artifact_id, 'nightly', 'nightly', CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END, branch, sha, 'linux', arch, failpoint, false, false FROM image_versions
UNION ALL SELECT artifact_id, 'pre_release', 'release_test', product, tag, sha, 'linux', arch, failpoint, false, false FROM image_versions
UNION ALL SELECT artifact_id, 'single_image', 'release_test', product, branch, sha, 'linux', 'amd64', false, false, false FROM image_versions
UNION ALL SELECT artifact_id, 'arm_test', 'arm_test', product, NULL, sha, 'linux', 'arm64', false, false, false FROM image_versions
""")
def parse_paths(t: Inputs):
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in _KINDS])
    return stored_paths(t).select("artifact_id", F.explode(pairs).alias("p")).select(
        "artifact_id", "p.kind", artifacts.parse_artifact_path(F.col("p.path")).alias("r")
    ).select("artifact_id", "kind", "r.*")


@query("p6_detail_url", """
SELECT run_id, task_no, attempt,
  concat('https://ci.acme.example/blue/organizations/jenkins/', task_type, '/detail/', task_type, '/', CAST(attempt AS STRING), '/',
    CASE WHEN result IS DISTINCT FROM 'SUCCESS' AND task_name IN ('ut-check', 'gosec-check') THEN 'tests' ELSE 'pipeline' END) AS url,
  concat('https://ci.acme.example/blue/organizations/jenkins/', task_type, '/detail/', task_type, '/', CAST(attempt AS STRING), '/pipeline') AS kept_url,
  'ci.acme.example' AS host, task_type AS project, attempt AS number,
  CASE WHEN result IS DISTINCT FROM 'SUCCESS' AND task_name IN ('ut-check', 'gosec-check') THEN 'tests' ELSE 'pipeline' END AS tab
FROM (SELECT *, CASE task_type WHEN 'unit-test' THEN 'ut-check' WHEN 'gosec' THEN 'gosec-check' ELSE task_type END AS task_name FROM ci_attempts) a
""")
def detail_url(t: Inputs):
    task = F.when(F.col("task_type") == "unit-test", "ut-check") \
        .when(F.col("task_type") == "gosec", "gosec-check").otherwise(F.col("task_type"))
    url = results.detail_url(F.col("task_type"), F.col("attempt"), F.col("result"), task)
    return t.view("ci_attempts").select(
        "run_id", "task_no", "attempt", url.alias("url"),
        results.stored_url(F.col("task_type"), F.col("attempt")).alias("kept_url"),
    ).select("*", results.parse_detail_url(F.col("url")).alias("u")).select(
        "run_id", "task_no", "attempt", "url", "kept_url", "u.*")


@query("p6_page_url_parts", """
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       NULLIF(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '') AS path
FROM pages
""")
def page_url_parts(t: Inputs):
    url = F.col("url")
    return t.table("pages").select(
        "page_id", F.parse_url(url, F.lit("HOST")).alias("host"),
        F.parse_url(url, F.lit("PATH")).alias("path"))


@query("p7_task_defaults", """
SELECT run_id, task_no, attempt, CASE WHEN timeout > 1 THEN timeout ELSE 60 END AS timeout,
       CASE WHEN retry <= 10 THEN retry ELSE 0 END AS retry
FROM task_inputs
""")
def task_defaults(t: Inputs):
    return task_ops.apply_task_defaults(
        t.view("task_inputs").select("run_id", "task_no", "attempt", "timeout", "retry"))


@query("p8_default_resources", """
WITH flags AS (
  SELECT *, COALESCE(length(request_cpu) >= 1 AND length(request_memory) >= 1, false) AS has_requests,
         COALESCE(length(limit_cpu) >= 1 AND length(limit_memory) >= 1, false) AS has_limits
  FROM task_inputs)
SELECT run_id, task_no, attempt,
       CASE WHEN NOT has_requests THEN '1000m' WHEN NOT has_limits THEN request_cpu ELSE limit_cpu END AS limit_cpu,
       CASE WHEN NOT has_requests THEN '2Gi' WHEN NOT has_limits THEN request_memory ELSE limit_memory END AS limit_memory,
       CASE WHEN NOT has_requests THEN '1000m' WHEN has_limits THEN request_cpu END AS request_cpu,
       CASE WHEN NOT has_requests THEN '2Gi' WHEN has_limits THEN request_memory END AS request_memory,
       has_requests AND NOT has_limits AS requests_dropped
FROM flags
""")
def default_resources(t: Inputs):
    def block(kind):
        return F.struct(F.col(f"{kind}_memory").alias("memory"), F.col(f"{kind}_cpu").alias("cpu"))

    resources = F.struct(block("limit").alias("limits"), block("request").alias("requests"))
    r = tasks.default_resources(F.col("resources"))
    return t.view("task_inputs").withColumn("resources", resources).select(
        "run_id", "task_no", "attempt", r.alias("r")
    ).select(
        "run_id", "task_no", "attempt",
        F.col("r.limits.cpu").alias("limit_cpu"), F.col("r.limits.memory").alias("limit_memory"),
        F.col("r.requests.cpu").alias("request_cpu"),
        F.col("r.requests.memory").alias("request_memory"), "r.requests_dropped")


@query("p9_substitute_vars", """
SELECT task_id, replace(replace(concat('run ${', key_name, '} ${Z} ${', secret_id, '}'),
         concat('${', key_name, '}'), concat('$', key_name)),
         concat('${', secret_id, '}'), concat('$', secret_id)) AS script,
       concat('TARGET_BRANCH=', secret_id, ';', key_name, '=', secret_id) AS env
FROM secrets
""")
def substitute_vars(t: Inputs):
    key, ident = F.col("key_name"), F.col("secret_id")
    script = F.concat(F.lit("run ${"), key, F.lit("} ${Z} ${"), ident, F.lit("}"))
    env = tasks.env_list(ident, F.array(F.struct(ident.alias("value"), key.alias("key"))))
    return t.view("secrets").select(
        "task_id", tasks.substitute_vars(script, F.array(key), F.array(ident)).alias("script"),
        F.array_join(env, ";").alias("env"))


@query("p10_secret_vars", """
WITH pieces AS (
  SELECT task_id, secret_id, key_name,
         list_filter(str_split(secret_vars, ','), lambda x: len(str_split(rtrim(x, ':'), ':')) = 2) AS kept
  FROM secrets)
SELECT task_id, array_to_string(kept, '|') AS decoded, CAST(len(kept) AS INTEGER) AS n,
       concat(secret_id, ':', key_name, ',k2:v2') AS encoded
FROM pieces
""")
def secret_vars(t: Inputs):
    decoded = tasks.decode_secret_vars(F.col("secret_vars"))
    text = F.transform(decoded, lambda s: F.concat_ws(":", s["secretID"], s["key"]))
    pair = F.array(
        F.struct(F.col("secret_id").alias("secretID"), F.col("key_name").alias("key")),
        F.struct(F.lit("k2").alias("secretID"), F.lit("v2").alias("key")))
    return t.view("secrets").select(
        "task_id", F.array_join(text, "|").alias("decoded"), F.size(decoded).alias("n"),
        tasks.encode_secret_vars(pair).alias("encoded"))


@query("p11_release_tag", """
SELECT run_id, CASE WHEN starts_with(branch, 'release-')
       THEN concat('v', str_split(substr(branch, 9), '-')[1], '.0-nightly') ELSE 'v6.1.0-nightly' END AS release_tag
FROM branches
""")
def release_tag(t: Inputs):
    return t.view("branches").select(
        "run_id", refs.release_tag_for_branch(F.col("branch")).alias("release_tag"))


@query("p12_image_tag", """
SELECT run_id, replace(ref, '/', '-') AS branch_tag, concat(ref, '-pre') AS pre_tag FROM ci_runs
""")
def image_tag(t: Inputs):
    ref = F.col("ref")
    return t.view("ci_runs").select(
        "run_id", refs.image_tag(ref, "branch").alias("branch_tag"),
        refs.image_tag(ref, "pre_release").alias("pre_tag"))


@query("p13_image_name", """
WITH named AS (
  SELECT *, concat(CASE product WHEN 'tics' THEN 'tiflash' WHEN 'monitoring' THEN 'tidb-monitor-initializer' ELSE product END,
                   CASE WHEN arch = 'arm64' THEN '-arm64' ELSE '' END) AS pre_name
  FROM image_versions)
SELECT artifact_id,
  CASE WHEN failpoint THEN concat('hub.acme.example/qa/', pre_name, ':', tag, '-pre-failpoint')
       ELSE concat('hub.acme.example/qa/', pre_name, ':', tag, '-pre,acme/', pre_name, ':', tag, '-pre') END AS pre_release,
  concat('hub.acme.example/qa/', product, ':', tag, '-pre', CASE WHEN failpoint THEN '-failpoint' ELSE '' END, '-debug') AS pre_release_debug,
  concat('hub.acme.example/qa/', product, ':', branch) AS nightly,
  concat('hub.acme.example/qa/', product, ':', branch, '-debug-failpoint') AS nightly_debug_failpoint,
  concat('hub.acme.example/qa/', product, ':', branch, '-linux-arm64') AS nightly_arm64,
  concat('hub.acme.example/qa/', product, CASE WHEN arch = 'arm64' THEN '-arm64' ELSE '' END, ':', tag) AS hotfix,
  concat('hub.acme.example/ee-debug/', product, CASE WHEN arch = 'arm64' THEN '-arm64' ELSE '' END, ':', tag, '-debug') AS hotfix_debug
FROM named
""")
def image_name(t: Inputs):
    p, a, g, b, f = map(F.col, ["product", "arch", "tag", "branch", "failpoint"])
    return t.view("image_versions").select(
        "artifact_id",
        artifacts.prerelease_image(p, a, g, f).alias("pre_release"),
        artifacts.prerelease_debug_image(p, g, f).alias("pre_release_debug"),
        artifacts.nightly_image(p, b).alias("nightly"),
        artifacts.nightly_image(p, b, "debug-failpoint").alias("nightly_debug_failpoint"),
        artifacts.nightly_image(p, b, "linux-arm64").alias("nightly_arm64"),
        artifacts.hotfix_image(p, a, g).alias("hotfix"),
        artifacts.hotfix_image(p, a, g, debug=True).alias("hotfix_debug"))


@query("p14_toolchain_tier", """
SELECT run_id, CASE
  WHEN starts_with(tag, 'v') AND tag <= 'v5.1' THEN '1.13'
  WHEN starts_with(tag, 'v') AND tag > 'v5.1' AND tag < 'v6.0' THEN '1.16'
  WHEN starts_with(branch, 'release-') AND branch < 'release-5.1' THEN '1.13'
  WHEN starts_with(branch, 'release-') AND branch >= 'release-5.1' AND branch < 'release-6.0' THEN '1.16'
  WHEN starts_with(branch, 'hz-poc') OR starts_with(branch, 'arm-dup') THEN '1.16'
  WHEN product = 'tiem' THEN '1.16' ELSE '1.18' END AS toolchain
FROM branches
""")
def toolchain_tier(t: Inputs):
    return t.view("branches").select(
        "run_id",
        versions.toolchain_tier(F.col("tag"), F.col("branch"), F.col("product")).alias("toolchain"))


@query("p15_hotfix_toolchain", """
SELECT artifact_id,
  CASE WHEN product IN ('tidb', 'pd', 'tiflow') AND substr(tag, 2) < 'v5.2.0' THEN 'imagego1.13.7' ELSE 'imagego1.16.0' END AS strict,
  CASE WHEN product IN ('tidb', 'pd', 'tiflow') AND tag < 'v5.2.0' THEN 'imagego1.13.7' ELSE 'imagego1.16.0' END AS intended
FROM artifacts
""")
def hotfix_toolchain(t: Inputs):
    p, g = F.col("product"), F.col("tag")
    return t.view("artifacts").select(
        "artifact_id", versions.hotfix_toolchain(p, g).alias("strict"),
        versions.hotfix_toolchain(p, g, strict_reference=False).alias("intended"))


@query("p16_git_remote", """
SELECT run_id, concat('git@github.com:', CASE WHEN product IN ('tikv', 'importer', 'pd') THEN 'tikv'
         WHEN product = 'tiem' THEN 'acme-inc' ELSE 'acme' END, '/', product, '.git') AS remote,
  CASE WHEN length(pr) >= 1 THEN concat('+refs/pull/', pr, '/*:refs/remotes/origin/pr/', pr, '/*')
       ELSE '+refs/heads/*:refs/remotes/origin/*' END AS build_ref,
  CASE WHEN length(pr) >= 1 THEN concat('+refs/pull/', pr, '/*:refs/remotes/origin/pr/', pr, '/*')
       ELSE concat('+refs/heads/', branch, ':refs/remotes/origin/', branch) END AS cache_ref
FROM (SELECT *, CASE run_id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(run_id AS STRING) END AS pr FROM branches) b
""")
def git_remote(t: Inputs):
    pr = F.when(F.col("run_id") % 3 == 0, "").when(
        F.col("run_id") % 3 == 1, F.col("run_id").cast("string"))
    return t.view("branches").select(
        "run_id", refs.git_remote(F.col("product")).alias("remote"),
        refs.ref_spec(pr).alias("build_ref"), refs.ref_spec(pr, F.col("branch")).alias("cache_ref"))


@query("p17_commit_status", """
SELECT run_id, task_no, attempt,
  CASE result WHEN 'ABORTED' THEN 'error' WHEN 'FAILURE' THEN 'failure' WHEN 'SUCCESS' THEN 'success' ELSE 'error' END AS state,
  CASE result WHEN 'ABORTED' THEN 'Jenkins job aborted' WHEN 'FAILURE' THEN 'Jenkins job failed'
       WHEN 'SUCCESS' THEN 'Jenkins job success' ELSE 'Jenkins job meets something wrong' END AS description
FROM ci_attempts
""")
def commit_status(t: Inputs):
    return t.view("ci_attempts").select(
        "run_id", "task_no", "attempt", results.commit_status(F.col("result")).alias("s")
    ).select("run_id", "task_no", "attempt", "s.*")


@query("p18_classify_failure", """
SELECT event_id,
  CASE WHEN exc_class = 'FlowInterruptedException' THEN 'ABORTED'
       WHEN exc_class = 'AbortException' THEN CASE WHEN contains(message, 'exit code 143') THEN 'ABORTED' ELSE 'FAILURE' END
       WHEN exc_class = 'InterruptedException' THEN 'ABORTED'
       WHEN message IN ('hasBeenCached', 'hasBeenTested') THEN 'SUCCESS' ELSE 'FAILURE' END AS job,
  CASE WHEN exc_class = 'FlowInterruptedException' THEN 'FAILURE'
       WHEN exc_class = 'AbortException' THEN CASE WHEN contains(message, 'exit code 143') THEN 'ABORTED' ELSE 'FAILURE' END
       WHEN exc_class = 'InterruptedException' THEN 'ABORTED'
       WHEN message IN ('hasBeenCached', 'hasBeenTested') THEN 'SUCCESS' ELSE 'FAILURE' END AS merge_run
FROM build_errors
""")
def classify_failure(t: Inputs):
    c, m = F.col("exc_class"), F.col("message")
    return t.view("build_errors").select(
        "event_id", results.classify_failure(c, m).alias("job"),
        results.classify_failure(c, m, variant="merge").alias("merge_run"))


@query("p19_unstable_to_failure", """
SELECT run_id, task_no, attempt, CASE WHEN result = 'UNSTABLE' THEN 'FAILURE' ELSE result END AS result
FROM ci_attempts
""")
def unstable_to_failure(t: Inputs):
    return t.view("ci_attempts").select(
        "run_id", "task_no", "attempt",
        results.unstable_to_failure(F.col("result")).alias("result"))


@query("p20_coverage_message", """
SELECT p_partkey AS file_id,
  concat('Lines coverage ', CAST(CAST(round(p_size * 1.25, 2) AS FLOAT) AS STRING), '%.') AS message,
  concat(p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('Lines coverage ', CAST(CAST(round(p_size * 1.25, 2) AS FLOAT) AS STRING), '%.') END) AS summary
FROM part
""")
def coverage_message(t: Inputs):
    message = results.coverage_message((F.col("p_size") * 1.25).cast("string"))
    given = F.when(F.col("p_size") % 3 == 0, "").otherwise(message)
    return t.table("part").select(
        F.col("p_partkey").alias("file_id"), message.alias("message"),
        results.append_summary(F.col("p_brand"), given).alias("summary"))


@query("p21_task_line", """
SELECT run_id, task_no, attempt,
  CASE task_no % 3 WHEN 0 THEN concat(task_type, ' ', result) WHEN 1 THEN concat(task_type, ' ', result)
       ELSE concat(task_type, ' ', result, ': took ', CAST(duration_ms AS STRING)) END AS line
FROM ci_attempts
""")
def task_line(t: Inputs):
    summary = F.when(F.col("task_no") % 3 == 0, "").when(
        F.col("task_no") % 3 == 2, F.concat(F.lit("took "), F.col("duration_ms").cast("string")))
    return t.view("ci_attempts").select(
        "run_id", "task_no", "attempt",
        results.task_line(F.col("task_type"), F.col("result"), summary).alias("line"))


@query("p22_default_if_short", """
SELECT run_id, CASE WHEN length(PRODUCT) > 1 THEN PRODUCT ELSE REPO END AS product,
       CASE WHEN length(GIT_HASH) > 2 THEN GIT_HASH ELSE 'default-image' END AS image,
       CASE WHEN length(TARGET_BRANCH) > 0 THEN TARGET_BRANCH ELSE 'golangci-lint-report.xml' END AS report
FROM build_params
""")
def default_if_short(t: Inputs):
    return t.view("build_params").select(
        "run_id", refs.default_if_short(F.col("PRODUCT"), F.col("REPO"), 1).alias("product"),
        refs.default_if_short(F.col("GIT_HASH"), F.lit("default-image"), 2).alias("image"),
        refs.default_if_short(F.col("TARGET_BRANCH"), F.lit("golangci-lint-report.xml"), 0)
        .alias("report"))


@query("p23_url_encode_plan", """
SELECT p_partkey AS plan_id,
       replace(replace(replace(concat(p_name, '/', p_brand), ' ', '+'), '/', '%2F'), '#', '%23') AS encoded
FROM part
""")
def url_encode_plan(t: Inputs):
    name = F.concat_ws("/", "p_name", "p_brand")
    return t.table("part").select(
        F.col("p_partkey").alias("plan_id"),
        refs.url_encode_plan(name).alias("encoded"))


@query("p24_times", """
SELECT a.run_id, a.task_no, a.attempt, CAST(epoch_ms(a.start_ts) - epoch_ms(r.start_ts) AS BIGINT) AS since_run_ms,
       CAST(floor(epoch(a.start_ts)) AS BIGINT) AS start_s
FROM ci_attempts a JOIN ci_runs r ON a.run_id = r.run_id
""")
def times(t: Inputs):
    runs = t.view("ci_runs").select("run_id", F.col("start_ts").alias("run_start"))
    return t.view("ci_attempts").join(runs, "run_id").select(
        "run_id", "task_no", "attempt",
        results.duration_ms(F.col("run_start"), F.col("start_ts")).alias("since_run_ms"),
        results.epoch_seconds(F.col("start_ts")).alias("start_s"))


@query("p25_config_urls", """
SELECT run_id, concat('https://raw.acme.example/devops-config/main/', product, '/golangci-lint.yaml') AS lint_config,
  concat('https://raw.acme.example/devops-config/', CASE WHEN trigger_event = 'daily' THEN 'master' ELSE 'main' END,
         '/', product, '/', trigger_event, '.yaml') AS repo_config
FROM ci_runs
""")
def config_urls(t: Inputs):
    return t.view("ci_runs").select(
        "run_id", refs.lint_config_url(F.col("product")).alias("lint_config"),
        refs.repo_config_url(F.col("product"), F.col("trigger_event")).alias("repo_config"))


@query("p26_package_mode", """
SELECT artifact_id, CASE WHEN artifact_id % 7 = 0
    OR (product IN ('pd', 'tidb', 'tidb-test') AND CASE WHEN failpoint THEN '' ELSE tag END = '')
    OR product = 'tiem' THEN 'with_source' ELSE 'output_only' END AS mode
FROM image_versions
""")
def package_mode(t: Inputs):
    tag = F.when(F.col("failpoint"), "").otherwise(F.col("tag"))
    mode = artifacts.package_mode(F.col("product"), tag, F.col("artifact_id") % 7 == 0)
    return t.view("image_versions").select("artifact_id", mode.alias("mode"))


@query("p27_dm_web_ui", """
SELECT artifact_id, NOT ((starts_with(v, 'release-') AND v < 'release-6.0') OR (starts_with(v, 'v') AND v < 'v6.0.0')) AS web_ui,
  CASE WHEN os = 'linux' AND arch = 'arm64' THEN 'node-v16.14.0-linux-arm64'
       WHEN os = 'darwin' AND arch = 'arm64' THEN 'node-v16.14.0-darwin-arm64'
       WHEN os = 'darwin' AND arch = 'amd64' THEN 'node-v16.14.0-darwin-x64'
       ELSE 'node-v16.14.0-linux-x64' END AS node_package
FROM (SELECT *, CASE WHEN failpoint THEN branch ELSE tag END AS v, CASE WHEN debug THEN 'darwin' ELSE 'linux' END AS os FROM image_versions) i
""")
def dm_web_ui(t: Inputs):
    v = F.when(F.col("failpoint"), F.col("branch")).otherwise(F.col("tag"))
    os = F.when(F.col("debug"), "darwin").otherwise("linux")
    return t.view("image_versions").select(
        "artifact_id", versions.dm_web_ui(v).alias("web_ui"),
        versions.node_package(os, F.col("arch")).alias("node_package"))


@query("p28_attach_run_fields", """
SELECT run_id, concat(product, '-', kind) AS taskName, product AS pipelineName, trigger_event AS triggerEvent,
       branch, author AS commitID, CAST(run_id % 100 AS STRING) AS pullRequest, product AS repo, 'acme' AS owner,
       concat('http://files.acme.example/download/builds/acme/devops/cachecode/', product, '/', author, '/', product, '.tar.gz') AS cacheCodeURL
FROM branches CROSS JOIN (SELECT unnest(['build', 'lint']) AS kind) k
""")
def attach_run_fields(t: Inputs):
    product, none = F.col("product"), F.lit("stale")
    task = [F.struct(F.concat_ws("-", product, F.lit(k)).alias("taskName"),
                     none.alias("branch"), none.alias("cacheCodeURL")) for k in ("build", "lint")]
    runs = t.view("branches").select(
        F.col("run_id").alias("id"), product.alias("pipelineName"),
        F.col("trigger_event").alias("triggerEvent"), "branch", F.col("author").alias("commitID"),
        (F.col("run_id") % 100).cast("string").alias("pullRequest"), product.alias("repo"),
        F.lit(SITE.org).alias("owner"), F.array(*task).alias("tasks"))
    return task_ops.attach_run_fields(runs)


@query("p29_build_alias", """
WITH moved AS (
  SELECT *, CASE WHEN product = 'br' AND branch >= 'release-5.2' THEN 'tidb'
                 WHEN product = 'dumpling' AND branch >= 'release-5.3' THEN 'tidb'
                 WHEN product = 'ticdc' THEN 'tiflow'
                 WHEN product = 'tidb-lightning' THEN CASE WHEN branch >= 'release-5.2' THEN 'tidb' ELSE 'br' END
                 ELSE product END AS repo
  FROM image_versions)
SELECT artifact_id, repo AS nightly_repo, CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END AS nightly_product,
  CASE WHEN name = 'tiflash' THEN 'tics' ELSE product END AS hotfix_repo,
  CASE WHEN name = 'tiflash' THEN 'tics' ELSE name END AS hotfix_product,
  name IN ('tidb', 'tikv', 'pd') AS need_source
FROM (SELECT *, CASE WHEN product = 'tics' THEN 'tiflash' ELSE product END AS name FROM moved) m
""")
def build_alias(t: Inputs):
    p = F.col("product")
    name = F.when(p == "tics", "tiflash").otherwise(p)
    repo = joins.effective_repo(p, F.col("branch"), "nightly")
    return t.view("image_versions").select(
        "artifact_id", artifacts.build_alias(p, repo, "nightly").alias("n"),
        artifacts.build_alias(name, p, "hotfix").alias("h"),
    ).select("artifact_id", F.col("n.repo").alias("nightly_repo"),
             F.col("n.product").alias("nightly_product"), F.col("h.repo").alias("hotfix_repo"),
             F.col("h.product").alias("hotfix_product"), "h.need_source")
