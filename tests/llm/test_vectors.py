"""Vector codes and hard negatives against brute force."""

import hashlib
import math

import numpy as np
import pytest

from buildlens.llm import codes, threshold

NAN, INF = float("nan"), float("inf")
ODD_VECTORS = [
    (0, 1, [1.0, 2.0]), (20, 1, [1.0, None]), (40, 1, [NAN, 1.0]), (60, 2, [INF, 1.0]), (80, 2, [-INF, 1.0]),
    (81, 1, None), (None, 1, [1.0, 1.0]), (1, None, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 2, [-5.0, 0.01]),
    (0, 1, [1.0, 2.0]), (0, 1, [0.5, 2.0]), (7, 0, [1.0, 2.0]), (7, 0, [1.0, 2.0]), (50, 2, [0.0, 0.0]),
    (9, 2, [0.7, 1.0]), (10, 2, [0.7, 1.0]), (11, 1, [0.9, 1.1]), (150, None, [1.0, 1.0]), (12, 3, [-0.0, 0.0]),
]


def frame(spark, rows, kind="double"):
    """Vectors with more columns, of names that operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows],
                                 f"vec_id long, label int, embedding array<{kind}>, v int, code string, rank int")


def whole(rows, scale):
    return [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def slow_codes(rows, scale, parts, entries, rounds):
    rows = whole(rows, scale)
    dim = len(rows[0][2]) if rows else 0
    edge = [dim * p // parts for p in range(parts + 1)]
    first = {}
    for i, _, v in rows:
        key = math.inf if i is None else i
        first[key] = min(v, first.get(key, v))
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[list(v[a:b]) for v in start] for a, b in zip(edge, edge[1:])]

    def assign(p, v):
        x = v[edge[p]:edge[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in rows:
                groups.setdefault(assign(p, v)[1], []).append(v[edge[p]:edge[p + 1]])
            for k, found in groups.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found)]
    out = []
    for i, label, v in rows:
        found = [assign(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, name


def check_codes(spark, rows, kind="double", **kw):
    coded, books = codes.compress(frame(spark, rows, kind), **kw)
    got = sorted(((r.vec_id, r.label, r.code.hex(), r.error) for r in coded.collect()), key=str)
    want, name = slow_codes(rows, kw["scale"], kw["parts"], kw["entries"], kw["rounds"])
    assert got == sorted(want, key=str)
    assert all(codes.fingerprint(b) == name for b in books.values())


@pytest.mark.parametrize("spread,rounds", [(0.02, 3), (0.5, 2), (30.0, 4), (0.5, 0)])
def test_codes_of_random_vectors(spark, spread, rounds):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i % 3), rng.normal(0, spread, 7).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, None, rows[20][2]) for i in range(60)]
    check_codes(spark, rows, scale=64, parts=3, entries=13, rounds=rounds)


def test_codes_of_odd_vectors(spark):
    for entries in (1, 3, 64):
        check_codes(spark, ODD_VECTORS, scale=256, parts=2, entries=entries, rounds=2)
    check_codes(spark, ODD_VECTORS, scale=256, parts=4, entries=3, rounds=2)
    check_codes(spark, [], scale=256, parts=2, entries=3, rounds=2)
    coded, books = codes.compress(frame(spark, [(1, 1, [1.0]), (2, 1, [1.0, 2.0]), (3, 1, [])]))
    assert {(r.vec_id, r.error) for r in coded.collect()} == {(1, 0), (2, 0), (3, 0)} and len(books) == 3
    with pytest.raises(OverflowError):
        codes.compress(frame(spark, [(1, 1, [1e30])]))


def test_bounds_skip_and_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (3000, 3))
    history = [rng.integers(-400, 400, (20, 3))]
    first = codes.Bounds(history)
    code, bound, _ = first.measure(x)
    stamp, measured = np.zeros(len(x), np.uint8), []
    there_and_back = [rng.integers(-60, 60, (20, 3)) for _ in range(2)]
    for move in [there_and_back[0], -there_and_back[0], there_and_back[1], np.zeros((20, 3), np.int64)]:
        history.append(history[-1] + move)
        books = codes.Bounds(history)
        code, bound, stamp, own, again = books.assign(x, code, bound, stamp)
        d = codes.distances(x, history[-1])
        assert (code == d.argmin(1)).all() and (own == d.min(1)).all()
        measured.append(int(again.sum()))
    assert all(n < len(x) for n in measured)
    # An entry that came back has not moved: rows of the first stamp have their whole bound.
    assert (codes.Bounds(history[:1] + history[1:3]).moved[0] == 0).all()


def slow_negatives(rows, every, n_positives, n_negatives, scale):
    rows = [r for r in whole(rows, scale) if r[0] is not None and r[1] is not None]
    out = []
    for own, label, v in {(i, l, tuple(v)) for i, l, v in rows if i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), i, l) for i, l, w in rows if i != own and len(w) == len(v)]
        for s, positive, _ in sorted(x for x in scores if x[2] == label)[:n_positives]:
            fit = sorted(x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(own, positive, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(fit[:n_negatives])]
    return sorted(out)


@pytest.mark.parametrize("spread,step", [(0.02, 1), (0.3, 4), (5.0, 64)])
def test_hard_negatives_in_small_cells(spark, spread, step, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(i), int(rng.integers(0, 4)), rng.normal(0, spread, 5).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, 2, rows[20][2]) for i in range(60)] + [(5000, 1, [0.0] * 5)]
    monkeypatch.setattr(threshold, "STEP", step)
    got = threshold.hard_negatives(frame(spark, rows), every=10, cell=90, asked=7)
    want = slow_negatives(rows, 10, 5, 3, 256)
    assert sorted(map(tuple, got.collect())) == want and want


def test_hard_negatives_of_odd_rows(spark):
    got = threshold.hard_negatives(frame(spark, ODD_VECTORS), every=10)
    # A repeated positive is a positive twice, each with its own rows.
    want = slow_negatives(ODD_VECTORS, 10, 5, 3, 256)
    assert sorted({tuple(r) for r in got.collect()}) == sorted(set(want)) and want
    assert threshold.hard_negatives(frame(spark, [])).count() == 0
    assert threshold.hard_negatives(frame(spark, [(50, 1, [1.0]), (51, 1, [1.0])])).count() == 0
    with pytest.raises(OverflowError):
        threshold.hard_negatives(frame(spark, [(50, 1, [1e30])]))


def test_search_ends_early_where_it_may():
    rng = np.random.default_rng(3)
    exact = np.c_[np.arange(4000), rng.integers(0, 9, 4000)]
    lists = threshold.SortedLists(np.arange(4000), exact)
    class Counted(np.ndarray):
        pass
    met = []
    whole_rows = lists.exact
    class Exact:
        def __getitem__(self, at):
            if not isinstance(at, tuple):
                met.append(len(at))
            return whole_rows[at]
    lists.exact = Exact()
    (rows, scores), = lists.best(np.array([100, 1]), np.ones(4000, bool), [(threshold.LEAST, threshold.MOST)], 3)
    assert rows.tolist() == [3999, 3998, 3997] and sum(met) < 400
