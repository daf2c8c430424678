from buildlens.operators import checkers
from pyspark.sql import functions as F


def test_errors_become_results(rows):
    def body(task):
        if task["n"] == 2:
            raise ValueError("no")
        return f"{task['n']} of {task['timeout']}"

    df = rows([(1, None, 11), (2, 5, 1)], "n int, timeout int, retry int")
    got = {r.n: (r.status, r.result, r.error, r.retry) for r in checkers.run_checker(df, body).collect()}
    assert got == {1: ("passed", "1 of 60", None, 0), 2: ("failed", None, "no", 1)}


def test_types_without_a_checker_are_counted(rows):
    found = checkers.Checkers()
    found.register("a", lambda df: F.upper(df.x))
    found.register("b", lambda df: F.lower(df.x))
    df = rows([("a", "Q"), ("b", "Q"), ("c", "Q"), (None, "Q")], "task_type string, x string")
    assert sorted(r.checked for r in found.run(df).collect()) == ["Q", "q"]
    assert {r.task_type: r.skipped for r in found.skipped(df).collect()} == {"c": 1, None: 1}


def test_ids_and_nulls_reach_the_body_unchanged(rows):
    big = (1 << 60) + 1
    df = rows([(big, None, None), (None, 1, 0)], "id long, timeout int, retry int")
    got = {(r.id, r.result) for r in checkers.run_checker(df, lambda t: repr(t["id"])).collect()}
    assert got == {(big, str(big)), (None, "None")}


def test_a_body_is_tried_again(rows):
    tries = {}

    def body(task):
        tries[task["n"]] = tries.get(task["n"], 0) + 1
        if tries[task["n"]] < 3:
            raise ValueError(f"try {tries[task['n']]}")
        return "done"

    df = rows([(1, 1, 3), (2, 1, 2), (3, 1, 0)], "n int, timeout int, retry int").coalesce(1)
    got = {r.n: (r.status, r.result, r.error) for r in checkers.run_checker(df, body).collect()}
    assert got == {1: ("passed", "done", None), 2: ("failed", None, "try 2"), 3: ("failed", None, "try 1")}


def test_bodies_and_frames_register_like_expressions(rows):
    found = checkers.Checkers()
    found.register("a", lambda df: F.upper(df.x))
    found.register_body("b", lambda t: t["x"] + "!")
    found.register_frame("c", lambda df: df.withColumns({"lines": F.lit(3), "bad": F.lit(1)}))
    df = rows([("a", "q", None, None), ("b", "q", None, 1), ("c", "q", None, None), ("d", "q", None, None)],
              "task_type string, x string, timeout int, retry int")
    got = {r.task_type: r for r in found.run(df).collect()}
    assert sorted(got) == ["a", "b", "c"] and got["a"].checked == "Q" and got["a"].lines is None
    assert (got["b"].status, got["b"].result) == ("passed", "q!") and (got["c"].lines, got["c"].bad) == (3, 1)


def test_tasks_are_not_read_again_for_each_type(spark, rows, tmp_path):
    rows([(t, i, None, None) for i, t in enumerate("abcdefgh")],
         "task_type string, x int, timeout int, retry int").write.parquet(str(tmp_path / "tasks"))
    df = spark.read.parquet(str(tmp_path / "tasks"))
    found = checkers.Checkers()
    for t in "ab":
        found.register(t, lambda df: df.x.cast("string"))
    for t in "cde":
        found.register_body(t, lambda task, t=t: f"{t} {task['x']}")
    for t in "fgh":
        found.register_frame(t, lambda df, t=t: df.withColumn("frame", F.lit(t)))
    got = found.run(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/tasks]") <= 2 and plan.count("MapInArrow") == 1
    assert {r.task_type: r.checked or r.result or r.frame for r in got.collect()} == {
        "a": "0", "b": "1", "c": "c 2", "d": "d 3", "e": "e 4", "f": "f", "g": "g", "h": "h"}
    assert checkers.Checkers().run(df).count() == 0
