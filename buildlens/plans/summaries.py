"""Queries for aggregations, windows, sorting and set operations."""

from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.functions import artifacts, refs, results
from buildlens.operators import aggregates, filters, sets, tasks, windows
from buildlens.plans.registry import Inputs, query
from buildlens.plans.rows import _list


@query("a1_it_summary", """
SELECT run_id, success, failed, success + failed AS total,
  CASE WHEN failed > 0 THEN concat('failed ', CAST(failed AS STRING), ', success ', CAST(success AS STRING), ', total ', CAST(success + failed AS STRING))
       ELSE concat('all ', CAST(success + failed AS STRING), ' tests passed') END AS summary
FROM (SELECT run_id, count(*) FILTER (WHERE status = 'success') AS success,
             count(*) FILTER (WHERE status IS DISTINCT FROM 'success') AS failed FROM it_subtasks GROUP BY 1) c
""")
def it_summary(t: Inputs):
    return aggregates.it_summary(t.view("it_subtasks"), ["run_id"])


@query("a2_run_outcome", """
WITH ok AS (SELECT run_id, bool_and(result IS NOT DISTINCT FROM 'SUCCESS') AS ok, count(*) AS n FROM ci_attempts GROUP BY 1)
SELECT r.run_id, r.product, COALESCE(n, 0) AS tasks, CASE WHEN COALESCE(ok, true) THEN 'passed' ELSE 'failed' END AS status,
       CASE WHEN COALESCE(ok, true) THEN 'SUCCESS' ELSE 'FAILURE' END AS result
FROM ci_runs r LEFT JOIN ok ON ok.run_id = r.run_id
""")
def run_outcome(t: Inputs):
    runs = t.view("ci_runs").select("run_id", "product")
    return aggregates.run_outcome(runs, t.view("ci_attempts"))


@query("a3_plan_outcome", f"""
WITH latest AS (SELECT exec_id, arg_max(status, (ts, event_id)) AS status FROM plan_status GROUP BY 1)
SELECT CAST(floor(exec_id / 100) AS BIGINT) AS run_id, count(*) AS executions,
       count(*) FILTER (WHERE status NOT IN ({_list(fixed.FINAL_STATES)})) AS open,
       CASE WHEN bool_or(status IN ({_list(fixed.ERROR_STATES)})) THEN 'failed' ELSE 'passed' END AS outcome
FROM latest GROUP BY 1
""")
def plan_outcome(t: Inputs):
    latest = windows.latest_status(t.view("plan_status"), ["exec_id"], ["ts", "event_id"])
    run = F.floor(F.col("exec_id") / 100).alias("run_id")
    return aggregates.plan_outcome(latest.select(run, "status"), ["run_id"])


@query("a4_junit_summary", """
SELECT suite, branch, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  count(*) FILTER (WHERE outcome = 'error') AS error, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) AS total,
  CASE WHEN count(*) FILTER (WHERE outcome IN ('failed', 'error')) > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS result
FROM test_cases GROUP BY 1, 2
""")
def junit_summary(t: Inputs):
    return aggregates.junit_summary(t.view("test_cases"), ["suite", "branch"])


@query("a5_coverage_gate", """
SELECT package_id, CAST(sum(hit) AS BIGINT) AS hits, count(hit) AS lines,
       CAST(sum(hit) AS BIGINT) * 100.0::DOUBLE / count(hit) AS rate,
       CAST(sum(hit) AS BIGINT) * 100.0::DOUBLE / count(hit) >= 50 AS passed
FROM coverage_lines GROUP BY 1
""")
def coverage_gate(t: Inputs):
    return aggregates.coverage_gate(t.view("coverage_lines"), ["package_id"])


@query("a6_cyclo_summary", """
SELECT package, count(*) AS functions, count(*) FILTER (WHERE complexity > 10) AS over_limit, max(complexity) AS worst,
       CAST(sum(complexity) AS DOUBLE) / count(*) AS average
FROM cyclo_functions GROUP BY 1
""")
def cyclo_summary(t: Inputs):
    return aggregates.cyclo_summary(t.view("cyclo_functions"), ["package"])


@query("a7_finding_summary", f"""
SELECT run_id, rule_id, count(*) AS findings FROM findings WHERE rule_id NOT IN ({_list(fixed.EXCLUDED_RULES)}) GROUP BY 1, 2
""")
def finding_summary(t: Inputs):
    return aggregates.finding_summary(filters.exclude_rules(t.view("findings")), ["run_id", "rule_id"])


@query("a8_vulnerability_summary", """
SELECT image, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total
FROM vulnerabilities GROUP BY 1
""")
def vulnerability_summary(t: Inputs):
    return aggregates.vulnerability_summary(t.view("vulnerabilities"), ["image"])


_URL = "concat('builds/hotfix/', product, '/', tag, '/', sha, '/centos7/', product, '-linux-', arch, '.tar.gz')"
_PATCH = "CASE WHEN product IN ('tikv', 'tidb', 'pd', 'ticdc') THEN concat('builds/hotfix/', product, '/', tag, '/', sha, '/centos7/', product, '-patch-linux-', arch, '.tar.gz') END"
_HOT = "concat('hub.acme.example/qa/', product, CASE WHEN arch = 'arm64' THEN '-arm64' ELSE '' END, ':', tag)"


@query("a9_assemble_hotfix", f"""
WITH steps AS (SELECT artifact_id, product, tag, arch, {_URL} AS url, {_PATCH} AS patch, {_HOT} AS image FROM artifacts),
links AS (SELECT tag, product, arg_max(url, artifact_id) FILTER (WHERE arch = 'amd64') AS amd64,
                 arg_max(url, artifact_id) FILTER (WHERE arch = 'arm64') AS arm64, arg_max(image, artifact_id) AS image,
                 arg_max(patch, artifact_id) FILTER (WHERE patch IS NOT NULL) AS patch FROM steps GROUP BY 1, 2),
texts AS (SELECT tag, product, concat('"', product, '":{{', array_to_string(list_filter([
    '"amd64":"' || amd64 || '"', '"arm64":"' || arm64 || '"', '"image":"' || image || '"', '"tiup-patch-amd64":"' || patch || '"'],
    lambda x: x IS NOT NULL), ','), '}}') AS text FROM links)
SELECT tag, concat('{{', string_agg(text, ',' ORDER BY product), '}}') AS results FROM texts GROUP BY 1
""")
def assemble_hotfix(t: Inputs):
    p, a, g = F.col("product"), F.col("arch"), F.col("tag")

    def path(kind: str):
        return artifacts.artifact_path(kind, product=p, commit=F.col("sha"), version=g, arch=a)

    steps = t.view("artifacts").select(
        "artifact_id", "product", "tag", "arch", path("hotfix").alias("url"),
        F.when(p.isin(*fixed.PATCHED_PRODUCTS), path("hotfix_patch")).alias("patch_url"),
        artifacts.hotfix_image(p, a, g).alias("image"))
    return aggregates.assemble_hotfix(steps, ["tag"], F.col("artifact_id"))


@query("a10_notify_receivers", """
WITH lists AS (SELECT *, CASE kind WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['lead', author] END AS lark FROM receivers),
told AS (SELECT run_id, list_concat(lark, [author], CASE WHEN length(trigger_author) > 0 THEN [trigger_author] ELSE [] END) AS r,
         lark, author, trigger_author FROM lists)
SELECT run_id, CASE WHEN lark IS NOT NULL THEN array_to_string(r, ',') END AS receivers,
  CASE WHEN lark IS NOT NULL THEN CAST(len(list_distinct(r)) AS INTEGER) END AS people,
  concat(author, CASE WHEN trigger_author <> author AND trigger_author <> '' THEN concat(',', trigger_author) ELSE '' END) AS legacy
FROM told
""")
def notify_receivers(t: Inputs):
    lark = F.when(F.col("kind") == 1, F.array().cast("array<string>")).when(
        F.col("kind") == 2, F.array(F.lit("lead"), F.col("author")))
    a, b = F.col("author"), F.col("trigger_author")
    unique = aggregates.notify_receivers(lark, a, b, unique=True)
    return t.view("receivers").select(
        "run_id", F.array_join(aggregates.notify_receivers(lark, a, b), ",").alias("receivers"),
        F.when(unique.isNotNull(), F.size(unique)).alias("people"),
        F.array_join(aggregates.notify_receivers(lark, a, b, flow="legacy"), ",").alias("legacy"))


_EMPTY = {n: f"COALESCE({n} = '', true)" for n in fixed.REQUIRED_BUILD_FIELDS}
_GAPS = ", ".join(
    [f"CASE WHEN {c} THEN '{n}' END" for n, c in _EMPTY.items()]
    + ["CASE WHEN COALESCE(RELEASE_TAG = '', true) AND COALESCE(TARGET_BRANCH = '', true) THEN 'RELEASE_TAG|TARGET_BRANCH' END"])


@query("a11_missing_fields", f"""
SELECT run_id, array_to_string(list_filter([{_GAPS}], lambda x: x IS NOT NULL), ',') AS missing FROM build_params
""")
def missing_fields(t: Inputs):
    return t.view("build_params").select(
        "run_id", F.array_join(tasks.missing_fields(), ",").alias("missing"))


@query("a11_missing_field_counts", f"""
SELECT field, count(*) AS requests FROM (SELECT unnest(list_filter([{_GAPS}], lambda x: x IS NOT NULL)) AS field FROM build_params) f GROUP BY 1
""")
def missing_field_counts(t: Inputs):
    return tasks.missing_field_counts(t.view("build_params"))


@query("a12_task_time", """
SELECT run_id, count(*) AS tasks, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
       max(epoch_ms(start_ts) + duration_ms) - min(epoch_ms(start_ts)) AS wall_ms
FROM ci_attempts GROUP BY 1
""")
def task_time(t: Inputs):
    df = t.view("ci_attempts").withColumn("start_ms", F.unix_millis(F.col("start_ts").cast("timestamp")))
    return aggregates.task_time(df, ["run_id"])


@query("w1_last_builds", """
SELECT task_type, run_id, task_no, attempt, build_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY task_type ORDER BY start_ts DESC, run_id DESC, task_no DESC, attempt DESC) AS INTEGER) AS build_rank
  FROM ci_attempts) r WHERE build_rank <= 10
""")
def last_builds(t: Inputs):
    order = [F.col(c).desc() for c in ("start_ts", "run_id", "task_no", "attempt")]
    return windows.last_builds(t.view("ci_attempts"), ["task_type"], order).select(
        "task_type", "run_id", "task_no", "attempt", "build_rank")


@query("w2_final_attempt", """
WITH tried AS (SELECT *, min(CASE WHEN result = 'SUCCESS' THEN attempt END) OVER p AS good, max(attempt) OVER p AS last
               FROM ci_attempts WHERE attempt <= 3 WINDOW p AS (PARTITION BY run_id, task_no))
SELECT run_id, task_no, task_type, attempt, result, duration_ms FROM tried WHERE attempt = COALESCE(good, last)
""")
def final_attempt(t: Inputs):
    return windows.final_attempt(t.view("ci_attempts"), ["run_id", "task_no"], 3).select(
        "run_id", "task_no", "task_type", "attempt", "result", "duration_ms")


@query("w3_latest_status", """
SELECT exec_id, event_id, ts, status FROM (
  SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY ts DESC, event_id DESC) AS r FROM plan_status) s WHERE r = 1
""")
def latest_status(t: Inputs):
    return windows.latest_status(t.view("plan_status"), ["exec_id"], ["ts", "event_id"])


@query("w4_status_transitions", """
WITH seen AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS previous_status
              FROM (SELECT CAST(floor(exec_id / 100) AS BIGINT) AS run_id, event_id, ts, status FROM plan_status) p),
changes AS (SELECT * FROM seen WHERE status IS DISTINCT FROM previous_status)
SELECT run_id, event_id, ts, status, previous_status,
       epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id)) - epoch_us(ts) AS in_state_us
FROM changes
""")
def status_transitions(t: Inputs):
    df = t.view("plan_status").select(
        F.floor(F.col("exec_id") / 100).alias("run_id"), "event_id", "ts", "status")
    return windows.status_transitions(df, ["run_id"])


@query("w5_parallel_load", """
WITH points AS (SELECT run_id, start_ts AS instant, 1 AS change, 1 AS starts FROM ci_attempts
                UNION ALL SELECT run_id, start_ts + to_milliseconds(duration_ms), -1, 0 FROM ci_attempts),
instants AS (SELECT run_id, instant, sum(change) AS change, sum(starts) AS starts FROM points GROUP BY 1, 2),
loads AS (SELECT run_id, instant, starts, sum(change) OVER (PARTITION BY run_id ORDER BY instant) AS running FROM instants)
SELECT run_id, instant, CAST(starts AS BIGINT) AS starts, CAST(running AS BIGINT) AS running FROM loads WHERE starts > 0
""")
def parallel_load(t: Inputs):
    df = t.view("ci_attempts").select(
        "run_id", F.col("start_ts"),
        F.expr("start_ts + make_dt_interval(0, 0, 0, CAST(duration_ms / 1000 AS DECIMAL(18,6)))").alias("end_ts"))
    return windows.parallel_load(df, ["run_id"], "start_ts", "end_ts", seconds=365 * 86_400)


@query("l1_distinct_sorted_tags", "SELECT DISTINCT tag FROM artifacts")
def distinct_sorted_tags(t: Inputs):
    return windows.distinct_sorted_tags(t.view("artifacts"))


@query("l2_first_plan", """
SELECT exec_id, event_id, ts, status FROM (
  SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY event_id) AS r FROM plan_status) s WHERE r = 1
""")
def first_plan(t: Inputs):
    return windows.first_plan(t.view("plan_status"), ["exec_id"], ["event_id"])


@query("l2_search_first_plan", """
WITH plans AS (SELECT run_id AS plan_id, concat(product, '-', branch, '-', author) AS name FROM branches),
queries AS (SELECT DISTINCT author AS query FROM ci_runs UNION SELECT 'd' UNION SELECT 'b-' UNION SELECT 'no such plan'),
found AS (SELECT q.query, min(p.plan_id) AS plan_id FROM queries q JOIN plans p ON contains(p.name, q.query) GROUP BY 1)
SELECT f.query, f.plan_id, p.name FROM found f JOIN plans p ON p.plan_id = f.plan_id
""")
def search_first_plan(t: Inputs):
    plans = t.view("branches").select(
        F.col("run_id").alias("plan_id"), F.concat_ws("-", "product", "branch", "author").alias("name"))
    queries = t.view("ci_runs").select(F.col("author").alias("query")).union(
        t.spark.range(1).select(F.explode(F.array(F.lit("d"), F.lit("b-"), F.lit("no such plan"))))).distinct()
    return windows.search_first_plan(queries, plans).select("query", "plan_id", "name")


@query("u1_union_images", """
WITH names AS (SELECT artifact_id, product AS image_product, branch FROM image_versions
               UNION ALL SELECT artifact_id, 'tiflash', branch FROM image_versions WHERE product = 'tics')
SELECT artifact_id, image_product, concat('hub.acme.example/qa/', image_product, ':', branch) AS image FROM names
UNION ALL SELECT artifact_id, image_product, concat('hub-new.acme.example/qa/', image_product, ':', branch) FROM names
""")
def union_images(t: Inputs):
    named = sets.with_alias_images(t.view("image_versions"))

    def images(registry: str):
        tag = refs.image_tag(F.col("branch"), "branch")
        return named.select(
            "artifact_id", "image_product",
            F.concat(F.lit(f"{registry}/qa/"), "image_product", F.lit(":"), tag).alias("image"))

    return sets.union_images(images("hub.acme.example"), images("hub-new.acme.example"))


@query("u2_open_executions", f"""
SELECT DISTINCT exec_id FROM plan_status p WHERE NOT EXISTS (
  SELECT 1 FROM plan_status q WHERE q.exec_id = p.exec_id AND q.status IN ({_list(fixed.FINAL_STATES)}))
""")
def open_executions(t: Inputs):
    polls = t.view("plan_status")
    finished = polls.filter(F.col("status").isin(*fixed.FINAL_STATES))
    return sets.open_executions(polls.select("exec_id").distinct(), finished, ["exec_id"])


@query("u3_union_runs", """
SELECT run_id, 'dailyci-pipeline' AS type, product AS repo, 'master' AS branch, CAST(NULL AS STRING) AS trigger, CAST(NULL AS STRING) AS prID,
       CAST(NULL AS STRING) AS triggerEvent FROM branches WHERE trigger_event = 'daily'
UNION ALL SELECT run_id, 'TiPipeline', product, branch, trigger_author, NULL, trigger_event FROM branches WHERE trigger_event = 'merge'
UNION ALL SELECT run_id, 'verifyci-pipeline', product, branch, COALESCE(NULLIF(trigger_author, ''), author), CAST(run_id % 1000 AS STRING), NULL
FROM branches WHERE trigger_event = 'verify'
""")
def union_runs(t: Inputs):
    runs = t.view("branches").withColumn("repo", F.col("product"))

    def layout(event: str, kind: str):
        return runs.filter(F.col("trigger_event") == event).withColumn("type", F.lit(kind))

    daily = layout("daily", "dailyci-pipeline").select(
        "run_id", "type", "repo", F.lit("master").alias("branch"))
    merge = layout("merge", "TiPipeline").select(
        "run_id", "type", "repo", "branch", F.col("trigger_author").alias("trigger"),
        F.col("trigger_event").alias("triggerEvent"))
    verify = layout("verify", "verifyci-pipeline").select(
        "run_id", "type", "repo", "branch",
        refs.resolve_trigger(F.col("trigger_author"), F.col("author")).alias("trigger"),
        (F.col("run_id") % 1000).cast("string").alias("prID"))
    return sets.union_runs(daily, merge, verify)


@query("failed_runs", f"""
WITH tried AS (SELECT *, CASE WHEN result = 'UNSTABLE' THEN 'FAILURE' ELSE result END AS settled FROM ci_attempts WHERE attempt <= 3),
marked AS (SELECT *, min(CASE WHEN settled = 'SUCCESS' THEN attempt END) OVER p AS good, max(attempt) OVER p AS last
           FROM tried WINDOW p AS (PARTITION BY run_id, task_no)),
decided AS (SELECT m.run_id, m.settled FROM marked m JOIN ci_runs r ON r.run_id = m.run_id
            WHERE m.attempt = COALESCE(good, last) AND m.task_type IN ({_list(fixed.TASK_TYPES['merge'])})),
ok AS (SELECT run_id, bool_and(settled IS NOT DISTINCT FROM 'SUCCESS') AS ok FROM decided GROUP BY 1),
runs AS (SELECT b.*, COALESCE(ok, true) AS ok FROM branches b LEFT JOIN ok ON ok.run_id = b.run_id)
SELECT product, trigger_event, branch, CASE WHEN ok THEN 'success' ELSE 'failure' END AS state, count(*) AS runs,
  count(*) FILTER (WHERE NOT ok) AS notified,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 + CASE WHEN COALESCE(NULLIF(trigger_author, ''), author) <> author THEN 1 ELSE 0 END END) AS BIGINT) AS messages
FROM runs GROUP BY 1, 2, 3, 4
""")
def failed_runs(t: Inputs):
    """Which runs failed after retries, by product and event, and how many people hear of it."""
    runs = t.view("ci_runs").withColumns({
        "branch": refs.normalize_ref(F.col("ref")),
        "trigger": refs.resolve_trigger(F.col("trigger_author"), F.col("author")),
    }).select("run_id", "product", "branch", "trigger_event", "author", "trigger")
    attempts = t.view("ci_attempts").select(
        "run_id", "task_no", "task_type", "attempt",
        results.unstable_to_failure(F.col("result")).alias("result"))
    decided = windows.final_attempt(attempts, ["run_id", "task_no"], 3)
    known = filters.known_task_types(
        decided.join(runs.select("run_id", "trigger_event"), "run_id"), F.col("trigger_event"))
    told = aggregates.notify_receivers(
        F.array().cast("array<string>"), F.col("author"), F.col("trigger"), unique=True)
    notify = filters.should_notify(F.col("result"), F.lit(None).cast("string"))
    return (
        aggregates.run_outcome(runs, known)
        .withColumns({"state": results.commit_status(F.col("result"))["state"],
                      "notify": notify, "told": F.size(told)})
        .groupBy("product", "trigger_event", "branch", "state")
        .agg(F.count("*").alias("runs"), F.count_if("notify").alias("notified"),
             F.sum(F.when(F.col("notify"), F.col("told")).otherwise(0)).alias("messages"))
    )
