"""Repeated byte strings and maximal repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from buildlens.llm import suffixarray
from buildlens.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose


def slow_removal(rows, window):
    """``id, bytes, removed, runs, digest`` of each row."""
    first, cut = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, data in cut:
        for k in range(len(data) - window + 1):
            if i is not None:
                key = data[k:k + window]
                first[key] = min(i, first.get(key, i))
    out = []
    for i, data in cut:
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - window + 1):
            least = first.get(data[k:k + window])
            if least is not None and (i is None or least < i):
                gone[k:k + window] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(data) else 0
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def slow_repeats(texts, least):
    found = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + least, len(text) + 1):
                found.setdefault(text[i:j], []).append((t, i))
    out = []
    for s, places in found.items():
        before = {(texts[t][i - 1],) if i else (t, i) for t, i in places}
        behind = {(texts[t][i + len(s)],) if i + len(s) < len(texts[t]) else (t, i) for t, i in places}
        if len(places) > 1 and len(before) > 1 and len(behind) > 1:
            out.append((s, sorted(places)))
    return sorted(out)


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("seed", range(25))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    least = rng.choice([1, 2, 3, 9])
    texts = [bytes(rng.choice(b"ab\x00\xf4") if least < 9 else rng.choice(b"ab")
                   for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
    if least == 9:
        texts += [texts[0] + b"x", b"y" + texts[0]]
    assert sorted(suffixarray.maximal_repeats(texts, least)) == slow_repeats(texts, least)


def test_equal_texts_and_texts_in_texts():
    assert suffixarray.maximal_repeats([b"abcabc"] * 3, 6) == [(b"abcabc", [(0, 0), (1, 0), (2, 0)])]
    assert suffixarray.maximal_repeats([], 4) == []
    assert suffixarray.maximal_repeats([b"", b"ab"], 4) == []


def test_anchors_do_not_cross_texts(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([30, 31, 80, 200]))) for _ in range(30)]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = suffixarray.anchors(data, ends, 30, 10)
    windows = {p for a, n in zip(whole[1], whole[2]) for p in range(a, a + n)}
    starts = np.r_[0, ends[:-1]]
    assert windows == {p for s, e in zip(starts, ends) for p in range(s, e - 29)} and whole[2].sum() == len(windows)
    # Equal windows have equal anchors.
    of = {}
    for h, a, n in zip(*whole):
        for p in range(a, a + n):
            assert of.setdefault(data[p:p + 30].tobytes(), h) == h
    monkeypatch.setattr(suffixarray, "STEP", 64)
    cut = suffixarray.anchors(data, ends, 30, 10)
    assert {p for a, n in zip(cut[1], cut[2]) for p in range(a, a + n)} == windows


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same(map(tuple, QUERIES["op11_prefix_intervals"](spark, folder).collect()), slow_removal(docs, 50))


@pytest.mark.parametrize("crowd", [suffixarray.CROWD, 0])
def test_odd_rows(odd, empty, crowd):
    got = suffixarray.remove_repeats(odd, crowd=crowd).collect()
    same([tuple(r)[:5] for r in got], slow_removal(ODD, 50))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixarray.remove_repeats(empty).count() == 0
    assert suffixarray.remove_repeats(odd.filter("doc_id = 2")).count() == 1


def shuffled_passages(seed, n):
    rng = random.Random(seed)
    passages = [prose(k, 25) for k in range(5)] + ["a" * 90, "\x00" * 70, "ab" * 40, "é" * 45]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            at = rng.randint(0, 40)
            text += p[at:at + rng.randint(5, 120)] + rng.choice(["", "", "q", "\x00"])
        rows.append((i // 2 if i % 17 else None, text))
    return rows + rows[:10]


@pytest.mark.parametrize("crowd,block", [(10_000, 4 << 20), (2, 300), (10_000, 300), (0, 4 << 20)])
def test_shuffled_passages(spark, crowd, block):
    rows = shuffled_passages(5, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixarray.remove_repeats(docs, 24, 9, crowd, block, 40, 200)
    same((tuple(r)[:5] for r in got.collect()), slow_removal(rows, 24))


def test_copies_edits_and_repeated_rows(spark):
    rng = random.Random(8)
    base = prose(4, 120)
    rows = [(i, base) for i in range(0, 600, 2)] + [(7, base)] * 200
    for i in range(1, 160, 2):
        at = rng.randint(0, len(base))
        rows.append((i, base[:at] + "#" + base[at + rng.randint(0, 3):]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixarray.remove_repeats(docs, block=2000, range_=50, shard=500)
    same((tuple(r)[:5] for r in got.collect()), slow_removal(rows, 50))


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_groups_name_all_occurrences(spark, crowd):
    rows = [(i, t) for i, (_, t) in enumerate(shuffled_passages(6, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    window = 24
    got = suffixarray.repeat_groups(docs, window, 9, crowd, 300, 40, 200).collect()
    texts = {}
    for i, t in reversed(rows):
        texts[t.encode()] = i
    texts = {i: t for t, i in texts.items()}
    strings, covered = {}, {}
    for r in got:
        string = texts[r.doc_id][r.start:r.start + r.length]
        assert len(string) == r.length >= window
        assert strings.setdefault(r.repeat, string) == string
        for k in range(r.start, r.start + r.length - window + 1):
            covered.setdefault(texts[r.doc_id][k:k + window], set()).add((r.doc_id, k))
    everywhere = {}
    for i, t in texts.items():
        for k in range(len(t) - window + 1):
            everywhere.setdefault(t[k:k + window], set()).add((i, k))
    # Each window of two documents is in the groups, at all its places.
    for string, places in everywhere.items():
        if len({i for i, _ in places}) > 1:
            assert covered[string] == places
