"""Queries for the sources and sinks.

Each writes files from the given tables with Spark, in the layout the reader expects,
and reads them back.
"""

from pyspark.sql import functions as F

from buildlens.operators import schedules as due
from buildlens.plans.registry import Inputs, query
from buildlens.session import scratch
from buildlens.sources import configs, reports, results


def _lines(*parts):
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _kv(key: str, col, indent: int = 0):
    return F.concat(F.lit(" " * indent + key + ": "), col.cast("string"))


@query("s1_run_specs", """
SELECT product AS name, 'acme' AS owner, product AS repo, branch AS defaultRef, run_id AS id, concat(author, ',pr-author,trigger') AS lark,
  list_extract(['6.10', '0123', 'on', '2021-13-45'], CAST(run_id % 4 AS INTEGER) + 1) AS pullRequest,
  concat(product, '-', kind) AS taskName, CASE WHEN kind = 'build' THEN CAST(run_id % 9 AS INTEGER) END AS timeout,
  CASE WHEN kind = 'build' THEN concat('make ', product) END AS script
FROM branches CROSS JOIN (SELECT unnest(['build', 'lint']) AS kind) k
""")
def run_specs(t: Inputs):
    product = F.col("product")
    # Text that YAML would take for numbers, a flag and a date.
    written = F.element_at(F.array(*map(F.lit, ("6.10", "0123", "on", "2021-13-45"))),
                           (F.col("run_id") % 4 + 1).cast("int"))
    doc = _lines(
        _kv("id", F.col("run_id")), _kv("pipelineName", product), _kv("pullRequest", written),
        F.concat(F.lit("repo: acme/"), product), _kv("defaultRef", F.col("branch")),
        "unknownField: 1", "notify:", F.concat(F.lit("  lark: ["), F.col("author"), F.lit("]")),
        "tasks:", F.concat(F.lit("- taskName: "), product, F.lit("-build")),
        _kv("timeout", F.col("run_id") % 9, 2), "  params:",
        F.concat(F.lit("    shellScript: make "), product),
        F.concat(F.lit("- taskName: "), product, F.lit("-lint")), "---",
    )
    path = scratch(t.spark, "specs")
    t.view("branches").select(doc.alias("value")).write.text(path)
    specs = configs.read_pipeline_specs(t.spark, path, "pr-author", "trigger")
    return specs.select(
        F.col("pipelineName").alias("name"), "owner", "repo", "defaultRef",
        F.col("id").cast("bigint").alias("id"), F.array_join("notify.lark", ",").alias("lark"),
        "pullRequest", F.explode("tasks").alias("task"),
    ).select("name", "owner", "repo", "defaultRef", "id", "lark", "pullRequest", "task.taskName", "task.timeout",
             F.col("task.params")["shellScript"].alias("script"))


@query("s2_legacy_tasks", """
SELECT branch AS defaultRef, taskType, concat(product, '-', CAST(run_id AS STRING)) AS name,
  CASE taskType WHEN 'build' THEN 'golang-1.16' WHEN 'common' THEN concat('img-', product) END AS image,
  CASE taskType WHEN 'build' THEN '8Gi' END AS limit_mem, CASE taskType WHEN 'unit-test' THEN '50' END AS coverageRate,
  CASE taskType WHEN 'unit-test' THEN concat(author, ':TOKEN') END AS secrets, CAST(NULL AS STRING) AS error
FROM branches CROSS JOIN (SELECT unnest(['build', 'unit-test', 'common']) AS taskType) k
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN run_id % 2 = 0 THEN 'tasks is no list' ELSE 'ParserError' END
FROM branches WHERE run_id % 5 = 0
""")
def legacy_tasks(t: Inputs):
    name = F.concat(F.lit("  name: "), F.col("product"), F.lit("-"), F.col("run_id").cast("string"))
    doc = _lines(
        _kv("defaultRef", F.col("branch")), "tasks:",
        "- taskType: build", name, "  outputDir: bin",
        "- taskType: unit-test", name, "  coverageRate: 50", "  secretVar:",
        F.concat(F.lit("  - {secretID: "), F.col("author"), F.lit(", key: TOKEN}")),
        "- taskType: common", name, "  buildEnv:",
        F.concat(F.lit("    image: img-"), F.col("product")), "---",
    )
    path = scratch(t.spark, "legacy")
    broken = F.when(F.col("run_id") % 2 == 0, F.lit("tasks: {a: 1}\n---")).otherwise("tasks: [unclosed\n---")
    branches = t.view("branches")
    branches.select(doc.alias("value")).union(
        branches.filter(F.col("run_id") % 5 == 0).select(broken)).write.text(path)
    secrets = F.transform("secretVar", lambda s: F.concat_ws(":", s["secretID"], s["key"]))
    return configs.read_legacy_tasks(t.spark, path).select(
        "defaultRef", "taskType", "name", F.col("buildEnv.image").alias("image"),
        F.col("buildEnv.limit.mem").alias("limit_mem"), "coverageRate",
        F.array_join(secrets, ",").alias("secrets"),
        F.substring_index("_error", ":", 1).alias("error"))


@query("s3_task_json", """
SELECT run_id, task_no, attempt, concat(task_type, '-check') AS taskName, CAST(task_no AS INTEGER) AS timeout,
  CASE WHEN run_id % 5 = 0 THEN 'unknown fields: extra' WHEN run_id % 5 = 1 THEN 'unknown fields: gpu' END AS error
FROM ci_attempts
""")
def task_json(t: Inputs):
    fifth = F.col("run_id") % 5
    block = F.struct(
        F.struct(F.lit("1Gi").alias("memory"), F.when(fifth == 1, "1").alias("gpu")).alias("limits"))
    text = F.to_json(F.struct(
        F.concat("task_type", F.lit("-check")).alias("taskName"), F.col("task_no").alias("timeout"),
        F.when(fifth == 0, 1).alias("extra"), block.alias("resources"),
        F.create_map(F.lit("anything"), F.lit("goes")).alias("params")))
    raw = t.view("ci_attempts").select("run_id", "task_no", "attempt", text.alias("text"))
    return configs.read_task_json(raw, "text").select(
        "run_id", "task_no", "attempt", "taskName", "timeout", F.col("_error").alias("error"))


@query("s4_ci_results", """
SELECT 'task' AS kind, CAST(run_id AS STRING) AS run_key, task_type AS name, result, CAST(attempt AS STRING) AS build, duration_ms AS duration, CAST(NULL AS STRING) AS receivers FROM ci_attempts
UNION ALL SELECT 'TiPipeline', CAST(run_id AS STRING), product, status, NULL, duration_ms, concat(author, ',lead') FROM branches
UNION ALL SELECT 'ci-notify', CAST(run_id AS STRING), 'ci-notify', NULL, NULL, NULL, author FROM branches
""")
def ci_results(t: Inputs):
    tasks = t.view("ci_attempts").select(
        "run_id", F.col("task_type").alias("name"), F.lit("task").alias("type"), "result",
        F.col("attempt").cast("string").alias("buildNumber"), F.col("duration_ms").alias("duration"))
    runs = t.view("branches").select(
        "run_id", F.col("product").alias("name"), F.col("status").alias("result"),
        F.lit("TiPipeline").alias("type"), F.col("duration_ms").alias("duration"),
        F.array("author", F.lit("lead")).alias("receiver_lark"))
    notifies = t.view("branches").select(
        "run_id", F.lit("ci-notify").alias("name"), F.lit("ci-notify").alias("type"),
        F.array("author").alias("lark"))
    path = scratch(t.spark, "results")
    results.write_ci_results(tasks, runs, path, notifies=notifies, compression="gzip")
    got_tasks, got_runs, got_notifies = results.read_ci_results(t.spark, path)

    def shape(df, receivers):
        empty = F.lit(None)
        return df.select(
            F.col("type").alias("kind"), "run_key", "name",
            (F.col("result") if "result" in df.columns else empty.cast("string")).alias("result"),
            (F.col("buildNumber") if "buildNumber" in df.columns else empty.cast("string")).alias("build"),
            (F.col("duration") if "duration" in df.columns else empty.cast("bigint")).alias("duration"),
            receivers.alias("receivers"))

    return (
        shape(got_tasks, F.lit(None).cast("string"))
        .unionByName(shape(got_runs, F.array_join("receiver_lark", ",")))
        .unionByName(shape(got_notifies, F.array_join("lark", ",")))
    )


@query("s5_it_subtasks", """
SELECT run_id, CAST(i - 1 AS INTEGER) AS sub_no, CASE WHEN i % 3 = 0 THEN NULL WHEN i % 2 = 0 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT run_id, unnest(generate_series(1, CAST(run_id % 5 AS BIGINT))) AS i FROM ci_runs WHERE status <> 'running') s
""")
def it_subtasks(t: Inputs):
    n = F.col("run_id") % 5
    subs = F.transform(
        F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)),
        lambda i: F.struct(F.lit("x").alias("job"), F.when(i % 3 == 0, F.lit(None)).when(
            i % 2 == 0, "failed").otherwise("success").alias("status")))
    text = F.when(F.col("status") != "running", F.coalesce(F.to_json(subs), F.lit("")))
    df = t.view("ci_runs").select("run_id", text.alias("description"))
    return results.read_it_subtasks(df)


@query("s6_junit", """
SELECT concat('case-', CAST(case_id AS STRING)) AS name, suite, CAST(time_ms AS DOUBLE) / 1000 AS time_s, outcome,
       CASE outcome WHEN 'failed' THEN 'expected 1' WHEN 'error' THEN 'boom' WHEN 'skipped' THEN 'not run' END AS message
FROM test_cases
""")
def junit(t: Inputs):
    def mark(outcome: str, message: str):
        return F.when(F.col("outcome") == outcome, F.struct(F.lit(message).alias("_message")))

    cases = t.view("test_cases").select(
        F.concat(F.lit("case-"), F.col("case_id").cast("string")).alias("_name"),
        F.col("suite").alias("_classname"), (F.col("time_ms") / 1000).alias("_time"),
        mark("failed", "expected 1").alias("failure"), mark("error", "boom").alias("error"),
        mark("skipped", "not run").alias("skipped"))
    path = scratch(t.spark, "junit")
    cases.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(path)
    return reports.read_junit(t.spark, path, allow_empty=False).drop("report")


@query("s7_cobertura", """
WITH lines AS (SELECT *, concat('pkg/', CAST(package_id AS STRING), '/f', CAST(file_id AS STRING), '.go') AS file FROM coverage_lines)
SELECT file, 'T' AS class, CAST(line AS BIGINT) AS line, CASE WHEN line = 1 THEN hit ELSE 1 END AS hit
FROM lines CROSS JOIN (SELECT unnest([1, 2]) AS line) n
""")
def cobertura(t: Inputs):
    file = F.concat(F.lit("pkg/"), F.col("package_id").cast("string"), F.lit("/f"),
                    F.col("file_id").cast("string"), F.lit(".go"))

    def line(number: int, hits):
        return F.struct(F.lit(number).alias("_number"), hits.alias("_hits"))

    classes = t.view("coverage_lines").select(
        file.alias("_filename"), F.lit("T").alias("_name"),
        F.struct(F.array(line(1, F.col("hit") * 3), line(2, F.lit(5))).alias("line")).alias("lines"))
    path = scratch(t.spark, "cobertura")
    classes.write.format("xml").option("rootTag", "classes").option("rowTag", "class").save(path)
    return reports.read_cobertura(t.spark, path)


@query("s8_codecov_totals", """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN p_size % 4 <> 0 THEN concat(CAST(p_size AS STRING), '.50000') END AS coverage,
  CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS BIGINT) END AS files, CASE WHEN p_size % 4 <> 0 THEN p_partkey END AS misses,
  CASE WHEN p_size % 4 <> 0 THEN '7' END AS diff_files, CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN p_brand END AS diff_coverage
FROM part
""")
def codecov_totals(t: Inputs):
    size = F.col("p_size")
    diff = F.concat(F.array(*[F.lit(str(v)) for v in (7, 6, 5, 4, 3)]),
                    F.when(size % 3 != 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")))
    totals = F.struct(
        F.concat(size.cast("string"), F.lit(".50000")).alias("c"), size.alias("f"), F.lit(9).alias("n"),
        F.lit(8).alias("h"), F.col("p_partkey").alias("m"), F.lit(0).alias("p"), diff.alias("diff"))
    body = F.to_json(F.struct(F.struct(totals.alias("totals")).alias("commit")))
    answers = t.table("part").select(
        F.col("p_partkey").alias("id"), F.when(size % 4 == 0, 404).otherwise(200).alias("status"),
        body.alias("body"))
    return results.read_codecov_totals(answers).select(
        "id", "status", "coverage", "files", "misses", "diff_files", "diff_coverage")


@query("s9_version_info", """
SELECT artifact_id, sha AS commit, replace(tag, 'v', '') AS tag FROM artifacts
""")
def version_info(t: Inputs):
    third = F.col("artifact_id") % 3 == 0
    text = _lines(
        F.concat(F.when(third, "Release Version: ").otherwise("Release version:  "), F.col("tag")),
        "Edition: Community",
        F.concat(F.when(third, "Git Commit Hash: ").otherwise("Git commit hash: "), F.col("sha")),
        "UTC Build Time: 2022-05-05 10:11:12")
    df = t.view("artifacts").select("artifact_id", text.alias("text"))
    return reports.parse_version_info(df, "text").select("artifact_id", "commit", "tag")


@query("s10_image_tags", """
SELECT DISTINCT name FROM (SELECT unnest([tag, concat(tag, '-', arch)]) AS name FROM artifacts) n
""")
def image_tags(t: Inputs):
    def entry(name):
        return F.struct(F.lit("").alias("layer"), name.alias("name"))

    text = F.to_json(F.array(entry(F.col("tag")), entry(F.concat_ws("-", "tag", "arch"))))
    return results.read_image_tags(t.view("artifacts").select(text.alias("tags")))


@query("s11_cyclo_log", """
SELECT complexity, package, concat('(*T).f', CAST(func_id AS STRING)) AS function, concat(package, '/x.go') AS file,
       func_id AS line, CAST(1 AS BIGINT) AS "column"
FROM cyclo_functions
""")
def cyclo_log(t: Inputs):
    functions = t.view("cyclo_functions").select(F.concat(
        F.col("complexity").cast("string"), F.lit(" "), F.col("package"), F.lit(" (*T).f"),
        F.col("func_id").cast("string"), F.lit(" "), F.col("package"), F.lit("/x.go:"),
        F.col("func_id").cast("string"), F.lit(":1")).alias("value"))
    average = t.view("cyclo_functions").select(
        F.concat(F.lit("Average: "), F.avg("complexity").cast("string")).alias("value"))
    path = scratch(t.spark, "cyclo")
    functions.unionByName(average).write.text(path)
    return reports.read_cyclo_log(t.spark, path)


@query("s12_schedules", """
SELECT run_id, concat('0 ', CAST(run_id % 24 AS STRING), ' * * *') AS cron, branch, 'false' AS rebuild FROM branches
UNION ALL SELECT run_id, '0 19 * * *', 'master', 'true' FROM branches
""")
def schedules(t: Inputs):
    text = _lines(
        "", F.concat(F.lit("    0 "), (F.col("run_id") % 24).cast("string"),
                     F.lit(" * * * % GIT_BRANCH="), F.col("branch"), F.lit(";FORCE_REBUILD=false")),
        "", "    0 19 * * * % GIT_BRANCH=master;FORCE_REBUILD=true", "")
    df = t.view("branches").select("run_id", text.alias("schedules"))
    return configs.read_schedules(df).select(
        "run_id", "cron", F.col("params")["GIT_BRANCH"].alias("branch"),
        F.col("params")["FORCE_REBUILD"].alias("rebuild"))


@query("s13_written_results", """
SELECT CAST(r.run_id AS STRING) AS run_key, count(*) + 1 AS records, count(a.run_id) AS tasks
FROM branches r LEFT JOIN ci_attempts a ON a.run_id = r.run_id WHERE true GROUP BY r.run_id HAVING count(a.run_id) > 0
UNION ALL SELECT CAST(run_id AS STRING), 1, 0 FROM branches r WHERE NOT EXISTS (SELECT 1 FROM ci_attempts a WHERE a.run_id = r.run_id)
UNION ALL SELECT CAST(run_id AS STRING), count(*), count(*) FROM ci_attempts a WHERE NOT EXISTS (SELECT 1 FROM ci_runs r WHERE a.run_id = r.run_id) GROUP BY run_id
""")
def written_results(t: Inputs):
    tasks = t.view("ci_attempts").select(
        "run_id", F.col("task_type").alias("name"), F.lit("task").alias("type"), "result")
    runs = t.view("branches").select(
        "run_id", F.col("product").alias("name"), F.lit("TiPipeline").alias("type"))
    path = scratch(t.spark, "written")
    results.write_ci_results(tasks, runs, path)
    got_tasks, got_runs, _ = results.read_ci_results(t.spark, path, layout="lines")
    return got_tasks.select("run_key", "type").unionByName(got_runs.select("run_key", "type")) \
        .groupBy("run_key").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "task").alias("tasks"))


@query("s14_facts", """
SELECT product AS repo, branch, author AS commit, task_type, result, count(*) AS n
FROM ci_attempts a JOIN branches b ON a.run_id = b.run_id GROUP BY ALL
""")
def facts(t: Inputs):
    rows = t.view("ci_attempts").select("run_id", "task_type", "result").join(
        t.view("branches").select("run_id", F.col("product").alias("repo"), "branch",
                                  F.col("author").alias("commit")), "run_id")
    path = scratch(t.spark, "facts")
    results.write_facts(rows, path)
    stored = t.spark.read.schema(rows.schema).parquet(path)
    return stored.groupBy("repo", "branch", "commit", "task_type", "result").agg(
        F.count("*").alias("n"))


@query("s15_checksums", """
SELECT page_id, sha256(html) AS checksum, CASE WHEN NOT starts_with(url, 'https') THEN 'unrecorded' WHEN contains(url, '?') THEN 'different' ELSE 'same' END AS status
FROM pages
""")
def checksums(t: Inputs):
    pages = t.table("pages")
    sums = pages.select("page_id", F.sha2("html", 256).alias("checksum"))
    altered = F.col("url").contains("?")
    known = pages.filter(F.col("url").startswith("https")).select(
        "page_id", F.sha2(F.when(altered, F.col("url")).otherwise(F.col("html")), 256).alias("checksum"))
    return reports.compare_checksums(sums, known, "page_id").select("page_id", "checksum", "status")


@query("s15_stored_checksums", """
WITH files AS (SELECT page_id % 32 AS shard, concat(string_agg(url, chr(10) ORDER BY page_id, url), chr(10)) AS content FROM pages WHERE url IS NOT NULL GROUP BY 1)
SELECT shard, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS checksum,
  CASE WHEN shard % 3 = 0 THEN 'unrecorded' WHEN shard % 3 = 1 THEN 'different' ELSE 'same' END AS status
FROM files
""")
def stored_checksums(t: Inputs):
    # An artifact for each of 32 shards of the pages: their addresses, in the order of their ids.
    path = scratch(t.spark, "artifacts")
    t.table("pages").filter("url IS NOT NULL").select((F.col("page_id") % 32).alias("shard"), "page_id", "url") \
        .repartition("shard").sortWithinPartitions("shard", "page_id", "url").drop("page_id") \
        .write.partitionBy("shard").text(path)
    shard = F.regexp_extract("path", "shard=([0-9]+)", 1).cast("bigint")
    sums = reports.checksum_artifacts(t.spark, path).withColumn("shard", shard)
    third = F.col("shard") % 3
    reports.write_checksums(sums.filter(third != 0).withColumn(
        "checksum", F.when(third == 1, F.sha2(F.col("checksum"), 256)).otherwise(F.col("checksum"))))
    recorded = reports.read_checksums(t.spark, path)
    return reports.compare_checksums(sums, recorded).select("shard", "bytes", "checksum", "status")


@query("x7_due_times", """
WITH crons AS (SELECT run_id, branch, CAST(run_id % 5 AS INT) AS k, CAST(run_id % 24 AS INT) AS h, CAST(run_id % 7 AS INT) AS w FROM branches),
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-02-26', TIMESTAMP '2024-03-10', INTERVAL 1 DAY)) AS DATE) AS day),
hours AS (SELECT unnest(range(24)) AS hour), minutes AS (SELECT unnest([0, 15, 30, 45]) AS minute)
SELECT run_id, branch, day + to_hours(CAST(hour AS INT)) + to_minutes(CAST(minute AS INT)) AS due, CASE k WHEN 3 THEN 60 ELSE 1 END AS minutes
FROM crons CROSS JOIN days CROSS JOIN hours CROSS JOIN minutes
WHERE CASE k WHEN 0 THEN hour = h AND minute = 0
             WHEN 1 THEN hour IN (8, 12) AND minute = 30 AND dayofweek(day) BETWEEN 1 AND 5
             WHEN 2 THEN hour = h AND (dayofmonth(day) = 1 OR dayofweek(day) = w)
             WHEN 3 THEN hour = h AND minute = 0 AND dayofweek(day) IN (0, 6) AND month(day) = 3 ELSE false END
""")
def due_times(t: Inputs):
    run = F.col("run_id")
    k, h, w = run % 5, (run % 24).cast("string"), (run % 7).cast("string")
    cron = F.when(k == 0, F.concat(F.lit("0 "), h, F.lit(" * * *"))) \
        .when(k == 1, "30 8,12 * * MON-FRI") \
        .when(k == 2, F.concat(F.lit("*/15 "), h, F.lit(" 1 * "), w)) \
        .when(k == 3, F.concat(F.lit("H "), h, F.lit(" * 3 6,7"))) \
        .otherwise("H H(2-5) * * *")
    text = _lines("", F.concat(F.lit("  "), cron, F.lit(" % GIT_BRANCH="), F.col("branch")), "")
    rows = configs.read_schedules(t.view("branches").select("run_id", text.alias("schedules")))
    found = due.due_times(rows, F.lit("2024-02-26"), F.lit("2024-03-10"))
    minutes = (F.unix_timestamp(F.col("until").cast("timestamp")) - F.unix_timestamp(F.col("due").cast("timestamp"))) / 60
    return found.select("run_id", F.col("params")["GIT_BRANCH"].alias("branch"), "due", minutes.cast("int").alias("minutes"))
