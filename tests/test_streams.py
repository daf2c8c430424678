"""Streams over several micro-batches against their batch answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import windows
from buildlens.session import scratch
from buildlens.streaming import batches, flows, waits

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def minutes(n):
    return START + dt.timedelta(minutes=n)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream with one micro-batch per list of rows."""
    def make(batches, schema):
        folder = str(tmp_path / "in")
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def drain(spark, df, name="out"):
    out = scratch(spark, name)
    flows.run_to_files(df, out, scratch(spark, f"{name}-checkpoint"))
    return spark.read.schema(df.schema).parquet(out).collect()


def test_wait_per_id(spark, stream):
    batches = [
        [(1, minutes(0), False), (2, minutes(0), False), (1, minutes(5), False), (4, minutes(3), True),
         (4, minutes(1), False), (4, minutes(9), True)],
        [(1, minutes(10), True), (1, minutes(12), True), (2, minutes(30), False), (3, minutes(20), False)],
        [(2, minutes(70), True), (3, minutes(60), False), (9, minutes(400), False)],
        [(2, minutes(410), True), (4, minutes(405), True)],
    ]
    polls = stream(batches, "id long, ts timestamp, finished boolean")
    got = drain(spark, waits.await_finished(polls, timeout_s=3600, delay="5 minutes"))
    at = lambda n: int(minutes(n).timestamp() * 1e6)
    assert sorted((r.id, r.outcome, r.answer_us, r.polls) for r in got) == [
        (1, "finished", at(10), 3), (2, "timed_out", at(60), 2), (3, "timed_out", at(80), 2),
        (4, "finished", at(3), 2)]


def test_wait_for_all_executions(spark, stream, rows):
    batches = [
        [(1, 11, minutes(0), "RUNNING"), (1, 12, minutes(1), "SUCCESS"), (2, 21, minutes(0), "ERROR"),
         (3, 31, minutes(2), "SKIPPED"), (3, 32, minutes(3), "RUNNING")],
        [(1, 11, minutes(4), "OMITTED"), (1, 11, minutes(6), "ERROR"), (2, 22, minutes(5), "SUCCESS")],
        [(4, 41, minutes(500), "RUNNING")],
        [(3, 32, minutes(510), "SUCCESS")],
    ]
    polls = stream(batches, "run_id long, exec_id long, ts timestamp, status string")
    expected = rows([(1, 2), (2, 2), (3, 2), (4, 1)], "run_id long, expected long")
    got = drain(spark, waits.await_all_plans(polls, expected, timeout_s=3600, delay="5 minutes"))
    at = lambda n: int(minutes(n).timestamp() * 1e6)
    assert sorted((r.run_id, r.outcome, r.answer_us, r.open) for r in got) == [
        (1, "passed", at(4), 0), (2, "failed", at(5), 0), (3, "timed_out", at(62), 1)]


def test_dedupe_across_batches(spark, stream):
    r = random.Random(1)
    data = [(r.choice("ab"), f"c{r.randrange(20)}", minutes(i)) for i in range(400)]
    requests = stream([data[i:i + 100] for i in range(0, 400, 100)], "repo string, commit string, ts timestamp")
    got = drain(spark, flows.dedupe_requests(requests, ["repo", "commit"], delay="10 days"))
    assert sorted((x.repo, x.commit) for x in got) == sorted({d[:2] for d in data})


def test_alerts_once_per_failed_run(spark, stream):
    batches = [[(1, "FAILURE", minutes(0)), (1, "FAILURE", minutes(1)), (2, "SUCCESS", minutes(1))],
               [(1, "FAILURE", minutes(2)), (3, "FAILURE", minutes(3))]]
    runs = stream(batches, "run_id long, result string, ts timestamp")
    assert sorted(r.run_id for r in alerts(spark, runs)) == [1, 3]
    assert sorted(r.run_id for r in alerts(spark, runs, policy="always")) == [1, 2, 3]


def alerts(spark, runs, **options):
    table = scratch(spark, "alerts")
    flows.failure_alerts(runs, table, scratch(spark, "alerts-checkpoint"), **options).awaitTermination()
    return spark.read.parquet(table).drop("batch").collect()


BIG = (1 << 60) + 1


def test_late_first_failures_alert_once_and_unchanged(spark, stream):
    batches = [[(1, "FAILURE", minutes(0), None), (2, "FAILURE", minutes(9000), BIG)],
               [(3, "FAILURE", minutes(5), BIG), (1, "FAILURE", minutes(9001), BIG), (4, "FAILURE", None, BIG)],
               [(None, "FAILURE", minutes(1), BIG), (2, "FAILURE", minutes(1), None)],
               [(None, "FAILURE", minutes(2), BIG), (3, "FAILURE", minutes(20000), None)]]
    runs = stream(batches, "run_id long, result string, ts timestamp, build long")
    got = {r.run_id: r.build for r in alerts(spark, runs)}
    assert got == {1: None, 2: BIG, 3: BIG, 4: BIG, None: BIG}


def test_windowed_dedupe_leaves_values_alone(spark, stream):
    rows = [(i % 3, minutes(i), BIG if i % 2 else None) for i in range(9)]
    requests = stream([rows], "repo long, ts timestamp, build long")
    got = drain(spark, flows.dedupe_requests(requests, ["repo"]))
    assert sorted(r.repo for r in got) == [0, 1, 2] and {r.build for r in got} <= {None, BIG}


def test_waits_keep_large_ids_and_reject_nulls(spark, stream, rows):
    batches = [[(BIG, minutes(0), False), (None, minutes(0), True), (BIG + 1, minutes(1), True),
                (BIG, None, True), (BIG, minutes(3000), True)], [(5, minutes(4000), True)]]
    polls = stream(batches, "id long, ts timestamp, finished boolean")
    got = drain(spark, waits.await_finished(polls, timeout_s=3600, delay="5 minutes"))
    assert {(r.id, r.outcome, r.polls) for r in got} == {
        (BIG, "timed_out", 1), (BIG + 1, "finished", 1), (5, "finished", 1)}
    flat = spark.createDataFrame(batches[0], "id long, ts timestamp, finished boolean")
    assert {tuple(r) for r in waits.rejected(flat, "id", "ts").collect()} == {("id", 1), ("ts", 1)}
    batches = [[(7, BIG, minutes(0), "SUCCESS"), (7, BIG + 1, minutes(1), "RUNNING"), (7, None, minutes(1), "ERROR"),
                (None, 3, minutes(1), "ERROR")], [(7, BIG + 1, minutes(2), "SUCCESS")]]
    expected = rows([(7, 2)], "run_id long, expected long")
    runs = stream_of(spark, batches, "run_id long, exec_id long, ts timestamp, status string")
    got = drain(spark, waits.await_all_plans(runs, expected, timeout_s=3600, delay="5 minutes"))
    assert [(r.run_id, r.outcome, r.open) for r in got] == [(7, "passed", 0)]


def stream_of(spark, batches, schema):
    folder = scratch(spark, "in")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_upserts_keep_the_last_status(spark, stream, tmp_path):
    r = random.Random(2)
    data = [(r.randrange(9), minutes(r.randrange(1000)), i, r.choice("xyz")) for i in range(200)]
    updates = stream([data[:70], data[70:150], data[150:]], "id int, ts timestamp, n int, status string")
    table, order = str(tmp_path / "table"), ["ts", "n"]
    flows.upsert_status(updates, table, ["id"], order, str(tmp_path / "ck")).awaitTermination()
    want = {}
    for d in sorted(data, key=lambda d: d[1:3]):
        want[d[0]] = d[3]
    read = lambda t: {x.id: x.status for x in flows.read_status(spark, t, ["id"], order).collect()}
    assert read(table) == want
    # A batch that runs again replaces its own folder.
    before = spark.read.parquet(table).count()
    flows.upsert_status(updates, table, ["id"], order, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(table).count() == before and read(table) == want
    compact = str(tmp_path / "compact")
    flows.compact_status(spark, table, compact, ["id"], order)
    assert read(compact) == want and spark.read.parquet(compact).count() == len(want)


def test_days_are_reported_when_over(spark, stream):
    batches = [[("main", "ok", minutes(1)), ("main", "ok", minutes(5)), ("main", "bad", minutes(7))],
               [("main", "ok", minutes(1440 + 30)), ("v1", "ok", minutes(1439))],
               [("main", "ok", minutes(1440 + 200))]]
    df = stream(batches, "branch string, outcome string, ts timestamp")
    got = drain(spark, flows.daily_branch_report(df, "branch", "outcome").select(
        F.unix_micros("day").alias("d"), "branch", "outcome", "n"))
    day = int(START.timestamp() * 1e6)
    assert sorted(tuple(r) for r in got) == [
        (day, "main", "bad", 1), (day, "main", "ok", 2), (day, "v1", "ok", 1)]


def test_first_rows_cost_their_batch_and_shrink_before_the_shuffle(spark, stream):
    """A hot key reaches its task as one row per Arrow batch; no table is read again."""
    runs = stream([[(1, "FAILURE", minutes(i)) for i in range(500)] + [(2, "FAILURE", None)],
                   [(1, "FAILURE", minutes(0)), (3, "FAILURE", minutes(1))]],
                  "run_id long, result string, ts timestamp")
    table = scratch(spark, "first")
    query = flows.keep_first(runs, table, ["run_id"], scratch(spark, "first-checkpoint"))
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in done] == [501, 2]
    assert sum(o["numRowsUpdated"] for p in done for o in p["stateOperators"]) <= 6
    got = {r.run_id: r.ts for r in spark.read.schema(runs.schema).parquet(table).collect()}
    assert sorted(got) == [1, 2, 3] and got[2] is None and got[1].timestamp() == minutes(0).timestamp()


def table_of(spark, path, fan=2):
    return batches.BatchTable(spark, path, lambda df: windows.latest_status(df, ["id"], ["n"]), fan)


def test_batches_are_merged_by_size(spark, rows, tmp_path):
    table, r, want, sizes = table_of(spark, str(tmp_path / "t")), random.Random(4), {}, []
    for number in range(13):
        data = [(r.randrange(30), number * 100 + i, r.choice("xyz")) for i in range(20)]
        want |= {d[0]: d[1:] for d in data}
        table.add(number, rows(data, "id int, n int, status string"))
        sizes.append(len(table.manifest()["live"]))
        assert {x.id: (x.n, x.status) for x in table.read().collect()} == want
    # Few folders at any time: one for each bit of the number of batches.
    assert max(sizes) <= 4 and sizes[-1] == bin(13).count("1")
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("batch=")]) < 13


def test_a_batch_that_runs_again_changes_nothing(spark, rows, tmp_path):
    table = table_of(spark, str(tmp_path / "t"), fan=3)
    data = [rows([(i, i * 10 + k, "x") for k in range(3)], "id int, n int, status string") for i in range(4)]
    for i in (0, 0, 1, 1):
        table.add(i, data[i])
    assert len(table.manifest()["live"]) == 2
    for i in (2, 3, 0, 2, 3):  # the first three are merged by now
        table.add(i, data[i])
    assert {x.id: x.n for x in table.read().collect()} == {0: 2, 1: 12, 2: 22, 3: 32}
    assert [x["through"] for x in table.manifest()["live"]] == [2, 3]
    with pytest.raises(ValueError):
        table_of(spark, str(tmp_path / "none")).read()


def test_a_crash_before_the_switch_loses_nothing(spark, rows, tmp_path, monkeypatch):
    table = table_of(spark, str(tmp_path / "t"), fan=2)
    schema = "id int, n int, status string"
    table.add(0, rows([(1, 1, "x"), (2, 1, "x")], schema))

    def crash(manifest):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(table, "_switch", crash)
        with pytest.raises(RuntimeError):
            table.add(1, rows([(1, 2, "y")], schema))
    assert {x.id: x.n for x in table.read().collect()} == {1: 1, 2: 1}
    switch = table._switch
    with monkeypatch.context() as m:
        # The batch is written, the merge is not.
        m.setattr(table, "_switch", lambda x: switch(x) if len(x["live"]) > 1 else crash(x))
        with pytest.raises(RuntimeError):
            table.add(1, rows([(1, 2, "y")], schema))
    assert {x.id: x.n for x in table.read().collect()} == {1: 2, 2: 1}
    table.add(1, rows([(1, 2, "y")], schema))
    assert {x.id: x.n for x in table.read().collect()} == {1: 2, 2: 1}
    assert len(table.manifest()["live"]) == 1


def test_late_rows_change_a_closed_day(spark, stream, tmp_path):
    batches_ = [[("main", "ok", minutes(1)), ("main", "ok", minutes(5)), ("v1", "ok", None)],
                [("main", "ok", minutes(1440 + 30))],
                [("main", "ok", minutes(1440 + 200)), ("main", "bad", minutes(8))],
                [("main", "ok", minutes(7)), ("main", "bad", minutes(9)), ("main", "ok", minutes(1440 + 10))],
                [("main", "ok", minutes(2 * 1440 + 59))]]
    df = stream(batches_, "branch string, outcome string, ts timestamp")
    table = str(tmp_path / "table")
    flows.daily_branch_counts(df, table, "branch", "outcome", str(tmp_path / "ck")).awaitTermination()

    def read(**options):
        return {(r.day and r.day.day, r.branch, r.outcome): (r.n, r.late)
                for r in flows.read_daily_counts(spark, table, **options).collect()}

    # The first day was closed when the last rows about it came; the second one is open.
    assert read() == {(1, "main", "ok"): (3, 1), (1, "main", "bad"): (2, 1)}
    assert read(closed=False) == read() | {
        (2, "main", "ok"): (3, 0), (3, "main", "ok"): (1, 0), (None, "v1", "ok"): (1, 0)}
