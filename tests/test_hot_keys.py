"""Operators against brute force, with one key that holds most rows and tiny crowds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import joins, ordered, windows

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def moment(r, days=4):
    """Most moments fall into one hour, the others anywhere."""
    span = 3600 if r.random() < 0.7 else days * 86_400
    return START + dt.timedelta(seconds=r.randrange(span))


def key(r):
    return "hot" if r.random() < 0.6 else f"k{r.randrange(5)}"


@pytest.fixture(params=[3, 10**6], ids=["crowded", "roomy"])
def crowd(request):
    return request.param


def test_running_sum(rows, crowd):
    r = random.Random(2)
    data = [(key(r), moment(r), r.randrange(-5, 6)) for _ in range(400)]
    data += [("hot", data[0][1], 1)] * 50
    df = rows(data, "k string, ts timestamp, v int")
    got = ordered.running_sum(df, ["k"], "ts", "v", "total", {"n": F.count("*")}, crowd=crowd).collect()
    assert len(got) == len({d[:2] for d in data}) and sum(x.n for x in got) == len(data)
    for x in got:
        at = x.ts.replace(tzinfo=dt.timezone.utc) if x.ts.tzinfo is None else x.ts
        assert x.total == sum(v for k, ts, v in data if k == x.k and ts <= at)


def test_commit_at_request_time(rows, crowd):
    r = random.Random(3)
    commits = [(key(r), moment(r), f"sha{i}", i) for i in range(120)]
    asked = [(i, key(r), moment(r)) for i in range(500)]
    got = joins.resolve_commit_asof(
        rows(asked, "id int, repo string, ts timestamp"),
        rows(commits, "repo string, ts timestamp, sha string, seen int"),
        ["repo"], "ts", tie="seen", crowd=crowd).collect()
    want = {}
    for i, repo, ts in asked:
        before = [(c[1], c[3], c[2]) for c in commits if c[0] == repo and c[1] <= ts]
        want[i] = max(before)[2] if before else None
    assert {x.id: x.commit for x in got} == want
    assert len(got) == len(asked)


def test_transitions_of_a_hot_id(rows, crowd):
    r = random.Random(4)
    data = [(key(r), moment(r), i, r.choice(["RUNNING", "ERROR", None])) for i in range(300)]
    df = rows(data, "id string, ts timestamp, event_id int, status string")
    got = windows.status_transitions(df, ["id"], crowd=crowd).collect()
    want = {}
    for k in {d[0] for d in data}:
        line = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        changes = [d for i, d in enumerate(line) if d[3] != (line[i - 1][3] if i else None)]
        for i, d in enumerate(changes):
            after = changes[i + 1][1] - d[1] if i + 1 < len(changes) else None
            want[d[2]] = after and int(after.total_seconds() * 1e6)
    assert {x.event_id: x.in_state_us or (x.in_state_us if x.in_state_us is None else
                                          dt.timedelta(0)) for x in got} == want


def test_parallel_load(rows, crowd):
    r = random.Random(5)
    data = []
    for _ in range(200):
        start = moment(r)
        data.append((key(r), start, start + dt.timedelta(seconds=r.randrange(1, 90_000))))
    df = rows(data, "run string, a timestamp, b timestamp")
    got = windows.parallel_load(df, ["run"], "a", "b", crowd=crowd).collect()
    for x in got:
        at = x.instant.replace(tzinfo=dt.timezone.utc) if x.instant.tzinfo is None else x.instant
        assert x.running == sum(k == x.run and a <= at < b for k, a, b in data)
    assert sum(x.starts for x in got) == len(data)


def test_final_attempt(rows):
    r = random.Random(6)
    data = [(t, a, r.choice(["SUCCESS", "FAILURE", None]))
            for t in range(60) for a in range(1, r.randrange(2, 7))]
    df = rows(data, "task int, attempt int, result string")
    for tries in (0, 1, 3):
        got = {x.task: (x.attempt, x.result)
               for x in windows.final_attempt(df, ["task"], tries).collect()}
        want = {}
        for t in range(60):
            tried = sorted((a, s) for k, a, s in data if k == t and a <= max(tries, 1))
            good = [x for x in tried if x[1] == "SUCCESS"]
            want[t] = good[0] if good else tried[-1]
        assert got == want


def test_attest_keeps_copies(rows):
    expected = rows([(1, "c1", "v1.0-nightly"), (2, "c2", "v1.0-nightly")], "id int, commit string, tag string")
    actual = rows([(1, "c1", "v1.0-nightly")] * 3 + [(1, "x", "v1.0-nightly"), (3, "c3", "v1-alpha"), (4, "c4", "v1")],
                  "id int, commit string, tag string")
    want = [(1, "fail"), (1, "pass"), (1, "pass"), (1, "pass"), (2, "missing"), (3, "unexpected")]
    got = sorted((x.id, x.status) for x in joins.attest(expected, actual, ["id"]).collect())
    assert got == want
    got = sorted((x.id, x.status) for x in joins.attest(expected, actual, ["id"], every_tag=True).collect())
    assert got == [*want, (4, "unexpected")]


def test_pending_and_existing_split_the_requests(rows):
    r = random.Random(7)
    requests = rows([(i, key(r), r.random() < 0.2) for i in range(300)], "id int, p string, force boolean")
    stored = rows([("hot",)] * 50 + [("k1",)] * 3, "p string")
    pending = joins.pending_builds(requests, stored, ["p"])
    existing = joins.existing_builds(requests, stored, ["p"])
    assert pending.unionAll(existing).groupBy("id").count().filter(F.col("count") != 1).count() == 0
    assert pending.count() + existing.count() == 300
    assert existing.filter("force OR p NOT IN ('hot', 'k1')").count() == 0


def test_last_builds_of_a_hot_job(rows):
    r = random.Random(8)
    data = [(key(r), i) for i in range(300)]
    got = windows.last_builds(rows(data, "job string, n int"), ["job"], [F.col("n").desc()], 4).collect()
    for job in {d[0] for d in data}:
        assert sorted(x.n for x in got if x.job == job) == sorted(n for k, n in data if k == job)[-4:]


@pytest.mark.parametrize("step", [3_000, 50], ids=["a burst of a minute", "a burst of a second"])
def test_pieces_hold_few_rows_in_a_burst(rows, step):
    crowd, n = 100, 20_000
    data = [("hot", START + dt.timedelta(hours=5, microseconds=i * step)) for i in range(n)]
    data += [("hot", START + dt.timedelta(seconds=i * 80)) for i in range(1000)]
    cut = ordered._cut(rows(data, "k string, ts timestamp"), ["k"], "ts", ordered.DAY, crowd)
    pieces = cut.groupBy("__piece").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("__piece").collect()
    assert sum(p.n for p in pieces) == n + 1000 and max(p.n for p in pieces) <= 2 * crowd
    assert all(x.b < y.a for x, y in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("crowd", [3, 10**6], ids=["crowded", "roomy"])
def test_inputs_are_scanned_twice_at_most(spark, rows, tmp_path, crowd):
    """Once for the histogram, which is stored, and once in the plan; request times come back by a join."""
    r = random.Random(9)
    rows([(key(r), moment(r), moment(r), i, r.choice("xy")) for i in range(200)],
         "k string, ts timestamp, b timestamp, n int, v string").write.parquet(str(tmp_path / "one"))
    rows([(key(r), moment(r), f"s{i}") for i in range(50)], "k string, ts timestamp, sha string") \
        .write.parquet(str(tmp_path / "two"))
    one, two = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "two"))

    def scans(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count(f"{tmp_path}/{name}]")

    assert scans(windows.status_transitions(one, ["k"], "ts", ["n"], "v", crowd=crowd), "one") == 0
    assert scans(windows.parallel_load(one, ["k"], "ts", "b", crowd=crowd), "one") == 1
    asof = joins.resolve_commit_asof(one, two, ["k"], "ts", crowd=crowd)
    assert scans(asof, "one") == 2 and scans(asof, "two") == 1


def test_rules_as_a_table(rows):
    r = random.Random(10)
    rules = [(i, r.choice([[], None, ["a"], ["a", "b"], ["c", ""], [""]]), r.choice(["", None, "arm", "amd"]),
              r.choice(["", "linux", "mac"]), f"l{i}") for i in r.sample(range(100), 12)]
    rules += [(None, [], "", "", "never"), (rules[0][0], [], "", "", "a tie")]
    asked = [(i, r.choice("abcd") if i % 9 else None, r.choice(["arm", "amd", "x", None]), r.choice(["linux", "mac", ""]))
             for i in range(200)]

    def match(rule, product, arch, os):
        number, products, a, o, _ = rule
        products = [p for p in products or [] if p]
        return number is not None and (not products or product in products) and \
            (not a or a == arch) and (not o or o == os)

    requests = rows([(*a, "x") for a in asked] * 2, "id int, product string, arch string, os string, label string")
    table = rows(rules, "rule_no int, products array<string>, arch string, os string, label string")
    got = joins.last_matching_rule(requests, table)
    assert got.columns == [*requests.columns, "host"] and got.count() == 400
    want = {i: max(((x[0], x[4]) for x in rules if match(x, p, a, o)), default=(0, None))[1] for i, p, a, o in asked}
    assert {x.id: x.host for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {x.host for x in joins.last_matching_rule(requests, table.limit(0)).collect()} == {None}


def test_moves_as_a_table(rows):
    r = random.Random(12)
    refs = [f"release-{r.randrange(9)}.{r.randrange(9)}" for _ in range(30)] + ["master", ""]
    moves = [(r.choice("abc"), r.choice([None, *refs]), r.choice([None, None, *refs]), f"r{i}") for i in range(25)]
    moves += [(None, None, None, "never"), ("a", "master", None, None)]
    asked = [(i, r.choice(["a", "b", "c", "d", None]), r.choice([None, *refs])) for i in range(300)]
    got = joins.moved_repo(rows(asked, "id int, product string, ref string"),
                           rows(moves, "product string, from_ref string, to_ref string, repo string"))
    want = {}
    for i, p, ref in asked:
        begun = [((m[1] or ""), m[3], m[2]) for m in moves if m[0] == p and p and m[3] and ref is not None and (m[1] or "") <= ref]
        last = max(begun, key=lambda m: (m[0], m[1], m[2] or ""), default=None)
        want[i] = last[1] if last and (last[2] is None or ref < last[2]) else p
    assert {x.id: x.repo for x in got.collect()} == want and got.columns == ["id", "product", "ref", "repo"]
    assert "moved" not in str(want) and len({*want.values()}) > 8


def test_name_search(rows):
    r = random.Random(13)
    names = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 9))) for _ in range(150)] + ["aaaa"] * 20 + [None]
    plans = [(i, n, f"p{i}") for i, n in enumerate(names)]
    queries = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 6))) for _ in range(120)] + [None, "zzz", "ab", "ab"]
    got = windows.search_first_plan(rows([(q, i) for i, q in enumerate(queries)], "query string, i int"),
                                    rows(plans, "plan_id int, name string, owner string"))
    want = {}
    for i, q in enumerate(queries):
        hits = [p for p in plans if q and p[1] is not None and q in p[1]]
        if hits:
            want[i] = min(hits)
    assert {x.i: (x.plan_id, x.name, x.owner) for x in got.collect()} == want
    assert got.columns == ["query", "i", "name", "plan_id", "owner"] and len(want) > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_name_search_neither_broadcasts_nor_compares(rows):
    """Stretches are many times what the planner estimates, and common stretches pair up with the square of the names."""
    plans = [(j, i, f"p-user{i}") for i in range(300) for j in (2, 1)]
    queries = [(f"user{i}",) for i in range(0, 300, 7)] + [("r",), ("p-",), ("er29",), ("serr",), ("user3000",)]
    got = windows.search_first_plan(rows(queries, "query string"), rows(plans, "day int, plan_id int, name string"),
                                    order=["day", "plan_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Contains" not in plan
    want = {q: min(p for p in plans if q in p[2]) for (q,) in queries if any(q in p[2] for p in plans)}
    assert {x.query: (x.day, x.plan_id, x.name) for x in got.collect()} == want and len(want) == len(queries) - 2
