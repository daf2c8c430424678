"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from buildlens.llm import vafile


def slow_nearest(rows, k, every):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable
                        if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 0.3, 40.0])
def test_nearest_in_small_cells(spark, spread, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, spread, 6).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)]
    monkeypatch.setattr(vafile, "SCAN", 32)
    monkeypatch.setattr(vafile, "READ", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vafile.nearest(df, k=7, every=20, cell_vectors=100, cell_queries=5)
    assert sorted(map(tuple, got.collect())) == slow_nearest(rows, 7, 20)


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, None), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.01]), (100, [1.0]), (5, [2.0]), (120, []),
            (0, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (140, [3e5, -4e6])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, v int, score int")
    assert sorted(map(tuple, vafile.nearest(df, k=4).collect())) == slow_nearest(rows, 4, 20)
    with pytest.raises(OverflowError):
        vafile.nearest(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))
    assert vafile.nearest(df.limit(0)).count() == 0
    assert vafile.nearest(df.filter("vec_id = 1")).count() == 0
