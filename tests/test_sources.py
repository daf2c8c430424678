"""Readers and writers on small hand-made files; the report layouts follow the public formats."""

import gzip
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from buildlens.sources import configs, reports, results


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_run_specs(spark, tmp_path):
    put(tmp_path, "a.yaml", """---
pipelineName: p
repo: org/name
defaultRef: master
surprise: 1
notify:
  email: [a@x]
  lark: [bob]
tasks:
- taskName: build
  checkerName: build-check
  retry: 2
  vars: [{key: K, value: v}]
  resources: {requests: {cpu: "2", memory: 4Gi}}
  params: {shellScript: make, flag: true}
""")
    put(tmp_path, "b.yaml", "pipelineName: q\nrepo: lonely\n---\npipelineName: r\nrepo: a/b/c\n")
    put(tmp_path, "c.yaml", "pipelineName: [broken\n")
    got = {r.pipelineName: r for r in configs.read_pipeline_specs(
        spark, str(tmp_path), "author", "").collect()}
    p = got["p"]
    assert (p.owner, p.repo, p.notify.lark, p.notify.email) == ("org", "name", ["bob", "author"], ["a@x"])
    task = p.tasks[0]
    assert (task.taskName, task.retry, task.vars[0].value, task.resources.requests.memory) == (
        "build", 2, "v", "4Gi")
    assert task.params == {"shellScript": "make", "flag": "true"}
    assert (got["q"].owner, got["q"].repo, got["q"].notify) == (None, "lonely", None)
    assert got["r"].repo == "a/b/c"
    assert got[None]._error


def test_legacy_tasks(spark, tmp_path):
    put(tmp_path, "daily.yaml", """defaultRef: master
notify: {lark: [x], email: []}
tasks:
- {taskType: build, name: b, outputDir: bin, shellScript: make}
- {taskType: unit-test, name: u, coverageRate: 60, secretVar: [{secretID: s, key: K}]}
- {taskType: common, name: c, buildEnv: {image: i, request: {cpu: 2, mem: 1Gi}}}
""")
    got = {r.name: r for r in configs.read_legacy_tasks(spark, str(tmp_path)).collect()}
    assert (got["b"].buildEnv.image, got["b"].buildEnv.limit.mem, got["b"].defaultRef) == (
        "golang-1.16", "8Gi", "master")
    assert (got["u"].coverageRate, got["u"].secretVar[0].key, got["u"].buildEnv) == ("60", "K", None)
    assert (got["c"].buildEnv.request.cpu, got["c"].buildEnv.limit) == ("2", None)


def test_task_json(rows):
    texts = [
        '{"taskName": "t", "retry": 1, "params": {"any": "thing"}}',
        '{"taskName": "t", "nope": 1}',
        '{"vars": [{"key": "a", "value": "b", "more": 1}], "resources": {"limits": {"gpu": "1"}}}',
        "not json",
    ]
    df = rows(list(enumerate(texts)), "i int, text string")
    strict = [r._error for r in configs.read_task_json(df, "text").orderBy("i").collect()]
    assert strict == [None, "unknown fields: nope", "unknown fields: more,gpu", "not a JSON object"]
    lenient = configs.read_task_json(df, "text", "lenient").orderBy("i").collect()
    assert [r.taskName for r in lenient] == ["t", "t", None, None]
    assert lenient[0].params == {"any": "thing"}


def test_schedules(rows):
    text = "\n  0 18 * * * % A=1;B=false\n\n  H 2 * * *\n"
    got = configs.read_schedules(rows([(text,)], "schedules string")).collect()
    assert [(r.cron, r.params) for r in got] == [("0 18 * * *", {"A": "1", "B": "false"}), ("H 2 * * *", None)]


def test_result_files(spark, tmp_path):
    put(tmp_path, "1.json", json.dumps([
        {"name": "t1", "type": "task", "result": "SUCCESS", "duration": 5, "startTime": 7},
        {"name": "run", "type": "TiPipeline", "result": "FAILURE", "receiver_lark": ["a"]}], indent=4))
    put(tmp_path, "2.json", json.dumps([
        {"name": "u", "type": "unit-test", "result": None},
        {"name": "job", "type": "dailyci-pipeline", "branch": "master"},
        {"name": "ci-notify", "type": "ci-notify", "lark": ["b"], "email": ["c"]}]))
    tasks, runs, notifies = results.read_ci_results(spark, str(tmp_path))
    assert sorted((r.name, r.type) for r in tasks.collect()) == [("t1", "task"), ("u", "unit-test")]
    assert sorted(r.name for r in runs.collect()) == ["job", "run"]
    assert [(r.lark, r.email) for r in notifies.collect()] == [(["b"], ["c"])]


def test_written_results_are_one_array_per_run(spark, rows, tmp_path):
    tasks = rows([(1, f"t{i}", "task") for i in range(40)] + [(2, "x", "task")],
                 "run_id int, name string, type string")
    runs = rows([(1, "r1", "TiPipeline"), (2, "r2", "TiPipeline"), (3, "r3", "TiPipeline")],
                "run_id int, name string, type string")
    notifies = rows([(i, "ci-notify", "ci-notify") for i in (1, 2, 3)],
                    "run_id int, name string, type string")
    out = tmp_path / "out"
    results.write_ci_results(tasks, runs, str(out), notifies=notifies)
    text = "".join(p.read_text() for p in sorted(out.glob("part-*.txt")))
    arrays, decoder = [], json.JSONDecoder()
    while text.strip():
        value, end = decoder.raw_decode(text.strip())
        arrays.append(value)
        text = text.strip()[end:]
    assert [len(a) for a in arrays] == [42, 3, 2]
    for a in arrays:
        assert [r["type"] for r in a[-2:]] == ["TiPipeline", "ci-notify"]
        assert all(r["type"] == "task" for r in a[:-2])


@pytest.fixture
def many_files(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_arrays_stay_in_one_file_but_for_crowded_runs(spark, rows, tmp_path, many_files):
    tasks = rows([(i % 60, f"t{i}", "task") for i in range(1500)] + [(7, f"hot{i}", "task") for i in range(900)],
                 "run_id int, name string, type string").repartition(8)
    runs = rows([(i, f"r{i}", "TiPipeline") for i in range(60)], "run_id int, name string, type string")
    for crowd, split in ((10_000, 0), (100, 1)):
        out = tmp_path / f"out{crowd}"
        results.write_ci_results(tasks, runs, str(out), crowd=crowd)
        texts = [p.read_text() for p in sorted(out.glob("part-*.txt"))]
        open_ended = sum(t.count("[\n") != t.count("]\n") for t in texts)
        assert len(texts) > 2 and (open_ended > 0) == bool(split)
        got, got_runs, _ = results.read_ci_results(spark, str(out), layout="lines")
        assert got.count() == 2400 and got_runs.count() == 60
        # Readers need not know: every file holds whole arrays.
        for whole in (results.WHOLE_BYTES, 100):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(results, "WHOLE_BYTES", whole)
                got, got_runs, _ = results.read_ci_results(spark, str(out))
            assert got.count() == 2400 and got_runs.count() == 60
            assert got.filter("_error IS NOT NULL").count() == 0 and got.filter("run_key = '7'").count() == 925


def test_written_results_take_little_disk(spark, rows, tmp_path, monkeypatch):
    """Packed files of few lines, no shuffle files left behind, and none made to read them."""
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toList()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    monkeypatch.setattr(results, "PACKED_LINES", 200)
    tasks = rows([(i % 60, f"t{i}", "task") for i in range(1500)] + [(7, f"hot{i}", "task") for i in range(900)]
                 + [(99, "alone", "task"), (99, "alone", "task")], "run_id int, name string, type string")
    tasks = tasks.repartition("name")
    runs = rows([(i, f"r{i}", "TiPipeline") for i in range(60)], "run_id int, name string, type string")
    before = shuffled()
    results.write_ci_results(tasks, runs, str(tmp_path / "o"), compression="gzip")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    texts = [gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "o").glob("part-*.gz")]
    assert sum(t.count("\n") for t in texts) == 2402 + 3 * 60 and max(t.count("\n") for t in texts) < 600
    assert all(t.count("[\n") == t.count("]\n") - t.count("}]\n") for t in texts)
    assert sum(t.count('[{"run_key":"99","name":"alone","type":"task"}]\n') for t in texts) == 2
    assert sum(t.count("}]\n") for t in texts) == 925 + 2
    got = results.read_ci_results(spark, str(tmp_path / "o"))
    for df in got:
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.run_key, r.name) for r in got[0].collect()) == sorted((str(r.run_id), r.name) for r in tasks.collect())
    assert got[0].filter("_error IS NOT NULL").count() == 0 and got[1].count() == 60


def test_subtasks(rows):
    df = rows([(1, '[{"status":"success"},{"x":1}]'), (2, ""), (3, None), (4, "[]")], "i int, description string")
    got = results.read_it_subtasks(df).collect()
    assert [(r.i, r.sub_no, r.status) for r in got] == [(1, 0, "success"), (1, 1, None)]


def test_junit(spark, tmp_path):
    path = put(tmp_path, "r.xml", """<testsuites><testsuite name="s">
<testcase classname="c" name="ok" time="0.5"/>
<testcase classname="c" name="bad"><failure message="want 1" type="t">trace</failure></testcase>
<testcase classname="c" name="broken"><error message="e"/></testcase>
<testcase classname="c" name="left"><skipped/></testcase>
<testcase classname="c" name="empty"><failure></failure></testcase>
</testsuite></testsuites>""")
    got = {r.name: (r.outcome, r.message) for r in reports.read_junit(spark, path).collect()}
    assert got == {"ok": ("passed", None), "bad": ("failed", "want 1"), "broken": ("error", "e"),
                   "left": ("skipped", None), "empty": ("failed", None)}


def test_empty_junit(spark, tmp_path):
    path = put(tmp_path, "e.xml", "<testsuites></testsuites>")
    assert reports.read_junit(spark, path).count() == 0
    put(tmp_path, "full.xml", '<testsuites><testsuite><testcase classname="c" name="ok"/></testsuite></testsuites>')
    got = reports.read_junit(spark, str(tmp_path), allow_empty=False).collect()
    assert sorted((r.report, r.name, r.outcome) for r in got) == [
        ("e.xml", None, "empty"), ("full.xml", "ok", "passed")]


def test_cobertura(spark, tmp_path):
    path = put(tmp_path, "c.xml", """<coverage><packages><package name="p"><classes>
<class name="-" filename="a/x.go"><methods/><lines><line number="3" hits="0"/><line number="4" hits="9"/></lines></class>
</classes></package></packages></coverage>""")
    got = reports.read_cobertura(spark, path).orderBy("line").collect()
    assert [(r.file, r.line, r.hit) for r in got] == [("a/x.go", 3, 0), ("a/x.go", 4, 1)]


def test_codecov(rows):
    body = json.dumps({"commit": {"totals": {"c": "81.23456", "f": 1, "n": 2, "h": 3, "m": 4, "p": 5,
                                             "diff": [1, 2, 3, 4, 5, "66.7"]}}})
    df = rows([(1, 200, body), (2, 404, body), (3, 200, '{"commit": {"totals": {"diff": [1]}}}')],
              "i int, status int, body string")
    got = results.read_codecov_totals(df).orderBy("i").collect()
    assert (got[0].coverage, got[0].misses, got[0].diff_files, got[0].diff_coverage) == (
        "81.23456", 4, "1", "66.7")
    assert (got[1].coverage, got[1].diff_files) == (None, None)
    assert (got[2].coverage, got[2].diff_files, got[2].diff_lines) == (None, "1", None)


def test_version_info(spark, tmp_path):
    put(tmp_path, "pd-server", "Release Version: v5.2.0-nightly\nGit Commit Hash: abc\nUTC: 1:2:3\n")
    put(tmp_path, "cdc", "Release version:  v5.2.0v\nGit commit hash:  def\n")
    got = {r.binary: (r.commit, r.tag) for r in reports.read_version_info(spark, str(tmp_path)).collect()}
    assert got == {"pd-server": ("abc", "5.2.0-nightly"), "cdc": ("def", "5.2.0v")}


def test_image_tags(rows):
    df = rows([('[{"layer":"","name":"v2"},{"name":"v10"}]',), ('[{"name":"v2"}]',), (None,)], "tags string")
    assert [r.name for r in results.read_image_tags(df).collect()] == ["v10", "v2"]


def test_cyclo_log(spark, tmp_path):
    path = put(tmp_path, "repo_cyclo.log", "25 pkg (*T).Run a/b.go:10:1\n11 pkg f a/c.go:2:3\nAverage: 3.4\n")
    got = reports.read_cyclo_log(spark, path).orderBy("complexity").collect()
    assert [(r.complexity, r.function, r.file, r.line) for r in got] == [
        (11, "f", "a/c.go", 2), (25, "(*T).Run", "a/b.go", 10)]


def test_facts_append(spark, rows, tmp_path):
    out = str(tmp_path / "facts")
    for n in (1, 2):
        results.write_facts(rows([("a", "c", n), ("b", "c", n)], "repo string, commit string, n int"), out)
    stored = spark.read.parquet(out)
    assert stored.count() == 4
    plan = stored.filter("repo = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan


def test_checksums(spark, tmp_path):
    for name, text in (("a.tar.gz", "one"), ("b.tar.gz", "two"), ("c.tar.gz", "three")):
        put(tmp_path, name, text)
    put(tmp_path, "a.tar.gz.sha256sum", hashlib.sha256(b"one").hexdigest() + "  a.tar.gz\n")
    put(tmp_path, "b.tar.gz.sha256sum", "0" * 64 + "  b.tar.gz\n")
    sums = reports.checksum_artifacts(spark, str(tmp_path))
    got = reports.compare_checksums(sums, reports.read_checksums(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in got.collect()} == {
        "a.tar.gz": "same", "b.tar.gz": "different", "c.tar.gz": "unrecorded"}
    md5 = reports.checksum_artifacts(spark, str(tmp_path), "md5").filter(F.col("path").endswith("a.tar.gz"))
    assert md5.collect()[0].checksum == hashlib.md5(b"one").hexdigest()
    by_spark = reports.checksum_artifacts(spark, str(tmp_path), open_file=None)
    assert sorted(map(tuple, by_spark.collect())) == sorted(map(tuple, sums.collect()))
    with pytest.raises(ValueError):
        reports.checksum_artifacts(spark, str(tmp_path), "crc")


def test_artifacts_of_any_size(spark, tmp_path):
    """Over 2 GB, which no value can hold; the file has holes, so it takes no disk."""
    size = (1 << 31) + 12345
    with open(tmp_path / "large.tar", "wb") as f:
        f.seek(size - 3)
        f.write(b"end")
    put(tmp_path, "a small one.tar", "x")
    want, left = hashlib.md5(), size - 3
    while left:
        want.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    want.update(b"end")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.checksum) for r in
           reports.checksum_artifacts(spark, str(tmp_path), "md5").collect()}
    assert got == {"large.tar": (size, want.hexdigest()), "a small one.tar": (1, hashlib.md5(b"x").hexdigest())}


def test_checksums_are_written_beside_their_files(spark, tmp_path):
    put(tmp_path, "a.so", "one")
    put(tmp_path, "b.so", "two")
    for algorithm in ("sha256", "md5"):
        sums = reports.checksum_artifacts(spark, str(tmp_path), algorithm)
        assert reports.write_checksums(sums) == 2 and reports.write_checksums(sums) == 2
        recorded = reports.read_checksums(spark, str(tmp_path))
        assert {r.status for r in reports.compare_checksums(sums, recorded.filter(
            F.length("checksum") == (64 if algorithm == "sha256" else 32))).collect()} == {"same"}
    assert (tmp_path / "a.so.md5").read_text() == hashlib.md5(b"one").hexdigest() + "  a.so\n"


def test_yaml_scalars_stay_as_written(spark, tmp_path):
    put(tmp_path, "a.yaml", """pipelineName: 2021-13-45
defaultRef: 6.10
branch: 0123
commitID: 1_000
status: on
id: 7
tasks: [{taskName: t, timeout: 0x10, params: {flag: yes, empty: ~}}]
""")
    r = configs.read_pipeline_specs(spark, str(tmp_path)).head()
    assert (r.pipelineName, r.defaultRef, r.branch, r.commitID, r.status, r.id) == (
        "2021-13-45", "6.10", "0123", "1_000", "on", 7)
    assert r.tasks[0].timeout == 16 and r.tasks[0].params == {"flag": "yes", "empty": None}


def test_no_document_is_lost(spark, tmp_path):
    (tmp_path / "crlf.yaml").write_bytes(
        b"tasks:\r\n- {taskType: a, name: one}\r\n---\r\ntasks:\r\n- {taskType: a, name: two}\r\n--- \r\n")
    put(tmp_path, "bad.yaml", "---\ntasks: [\n---\ntasks: {no: list}\n---\n- a\n---\n"
                              "? [x, y]\n: 1\n---\n# nothing\n---\ntasks:\n- {taskType: a, name: three}\n")
    rows = configs.read_legacy_tasks(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in rows if r._error is None) == ["one", "three", "two"]
    errors = [r._error for r in rows if r._error]
    assert len(errors) == 4 and "tasks is no list" in errors and all(r.name is None for r in rows if r._error)


def test_all_arrays_of_a_file_are_read(spark, tmp_path):
    put(tmp_path, "r.json", '[\n{"name": "a][b", "type": "task"},\n{"name": "r", "type": "TiPipeline"}\n]\n'
                            '[{"name": "c", "type": "task"}]\n')
    tasks, runs, _ = results.read_ci_results(spark, str(tmp_path))
    assert sorted(r.name for r in tasks.collect()) == ["a][b", "c"] and runs.count() == 1
    put(tmp_path, "half.json", '[\n{"name": "d", "type": "task"},\n')
    put(tmp_path, "other.json", "no JSON")
    put(tmp_path, "none.json", "\n[]\n")
    put(tmp_path, "number.json", '[{"name": "e", "type": "task", "duration": "soon", "startTime": 8}]')
    for whole in (results.WHOLE_BYTES, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(results, "WHOLE_BYTES", whole)
            tasks, runs, _ = results.read_ci_results(spark, str(tmp_path))
        got = tasks.collect()
        errors = {r.source.rsplit("/", 1)[1]: r._error for r in got if r.name is None}
        if whole:
            assert sorted(r.name for r in got if r.name) == ["a][b", "c", "e"] and runs.count() == 1
            assert errors == {"half.json": "not JSON arrays", "other.json": "not JSON arrays"}
        else:
            assert {"c", "e"} <= {r.name for r in got} and errors["half.json"] == "an array has no end"
        e, = (r for r in got if r.name == "e")
        assert (e.duration, e.startTime, e._error) == (None, 8, "duration is no number: soon")


def test_results_are_parsed_once(spark, rows, tmp_path):
    runs = rows([(1, "r1", "TiPipeline")], "run_id int, name string, type string")
    results.write_ci_results(rows([(1, "t", "task")], "run_id int, name string, type string"), runs, str(tmp_path / "o"))
    for df in results.read_ci_results(spark, str(tmp_path / "o")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "PartitionFilters: [isnotnull(kind" in plan


def test_artifacts_are_not_opened_for_their_sums(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(b"x")
    put(tmp_path, "a.tar.gz.sha256sum", "abc  a.tar.gz")
    put(tmp_path, "b.so.md5", "def  b.so")
    got = {r.path.rsplit("/", 1)[1]: r.checksum for r in reports.read_checksums(spark, str(tmp_path)).collect()}
    assert got == {"a.tar.gz": "abc", "b.so": "def"}


def test_fields_that_do_not_fit_are_named(spark, tmp_path):
    put(tmp_path, "a.yaml", "pipelineName: p\nid: 3000000000\nnotify: [x]\ntasks:\n"
                            "- {taskName: t, timeout: abc, retry: 08}\n- {taskName: u, timeout: 1.5, vars: {k: v}}\n"
                            "- {taskName: w, timeout: 0x10, retry: ~, params: []}\n- just text\n")
    put(tmp_path, "b.yaml", "pipelineName: q\ntasks: {}\n---\npipelineName: r\nid: 7\n")
    got = {r.pipelineName: r for r in configs.read_pipeline_specs(spark, str(tmp_path)).collect()}
    size = "no number of the field's size"
    assert got["p"]._error.split("; ") == [
        f"id is {size}: 3000000000", "notify is no mapping: ['x']", f"tasks[0].timeout is {size}: abc",
        f"tasks[0].retry is {size}: 08", f"tasks[1].timeout is {size}: 1.5", "tasks[1].vars is no list: {'k': 'v'}",
        "tasks[2].params is no mapping: []", "tasks[3] is no mapping: just text"]
    assert [t and (t.taskName, t.timeout, t.retry) for t in got["p"].tasks] == [
        ("t", None, None), ("u", None, None), ("w", 16, None), None]
    assert got["q"]._error == "tasks is no list: {}" and (got["r"].id, got["r"]._error) == (7, None)


def test_legacy_fields_that_do_not_fit_leave_the_others(spark, tmp_path):
    put(tmp_path, "a.yaml", "notify: x\ntasks:\n- {taskType: build, name: a, secretVar: {k: v}}\n")
    r, = configs.read_legacy_tasks(spark, str(tmp_path)).collect()
    assert (r.name, r.secretVar, r.buildEnv.image) == ("a", None, "golang-1.16")
    assert r._error == "notify is no mapping: x; tasks[0].secretVar is no list: {'k': 'v'}"


def test_junit_is_parsed_once(spark, tmp_path):
    put(tmp_path, "a.xml", '<testsuite><testcase name="n" classname="s" time="1"/></testsuite>')
    put(tmp_path, "b.xml", "<testsuite></testsuite>")
    df = reports.read_junit(spark, str(tmp_path), allow_empty=False)
    assert "FileScan xml" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.report, r.outcome) for r in df.collect()) == [("a.xml", "passed"), ("b.xml", "empty")]
