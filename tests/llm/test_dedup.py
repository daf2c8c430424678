"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from buildlens.llm import common, graph, simhash, substring
from buildlens.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def slow_components(rows):
    """The smallest id reached from each row of (id, unsigned fingerprint)."""
    codes = np.unique(np.array([f for _, f in rows], np.uint64))
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ c) <= 2).tolist():
            up[find(i)] = find(j)
    root = {int(c): find(i) for i, c in enumerate(codes)}
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f, least.get(root[f])) for i, f in rows]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def test_near_duplicates_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id)
           for r in QUERIES["op9_gray_simhash"](spark, folder).collect()]
    same(got, slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in docs]))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_near_duplicates_of_odd_rows(odd, empty, crowd):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd, crowd).collect()]
    same(got, slow_components([(i, slow_fingerprint(t)) for i, t in ODD]))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 30])
def test_links_of_dense_fingerprints(spark, crowd, monkeypatch):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for k in range(1500):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            code ^= 1 << rng.randint(0, 63)
        rows.append((k, code))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in {c for _, c in rows}]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), crowd)
    root = {r.node: r.root for r in graph.components(links).collect()}
    names = {}
    for k, code in rows:
        fp = code - (1 << 64) if code >> 63 else code
        names.setdefault(root.get(fp, fp), []).append(k)
    got = [(k, dict(rows)[k], min(v)) for v in names.values() for k in v]
    same(got, slow_components(rows))


def test_search_in_halves_gives_the_same_links(monkeypatch):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 12, 900).astype(np.uint64)
    codes = np.unique(codes)
    whole = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    label = whole.links()
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    assert (simhash.GrayIndex(np.zeros(len(codes), np.int64), codes).links() == label).all()


def test_gray_rank_is_the_place_in_the_sequence():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_keeps_whole_rows(odd, empty):
    got = simhash.one_of_each(odd)
    assert got.schema == odd.schema
    # The components are held against brute force above; several may have one smallest id.
    least = {r.root: r.component_id for r in simhash.near_duplicates(odd).collect()}
    same([r.doc_id for r in got.collect()], least.values())
    assert simhash.one_of_each(empty).count() == 0


def slow_removal(rows, window):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in cut:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in cut:
        gone = set()
        for k in range(len(words) - window + 1):
            least = first.get(tuple(words[k:k + window]))
            if least is not None and (i is None or least < i):
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same(map(tuple, QUERIES["op5_suffix_automata"](spark, folder).collect()), slow_removal(docs, 50))


@pytest.mark.parametrize("crowd", [substring.CROWD, 1])
def test_repeats_of_odd_rows(odd, empty, crowd):
    got = substring.remove_repeats(odd, crowd=crowd).collect()
    same([tuple(r)[:4] for r in got], slow_removal(ODD, 50))
    for r in got:
        assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256
    assert substring.remove_repeats(empty).count() == 0
    whole = substring.without_repeats(odd)
    assert whole.schema == odd.schema and whole.count() == len(ODD)
    untouched = {r.doc_id: r.text for r in whole.collect()}
    assert untouched[9] == "  two  spaces \n" and untouched[1] is None


@pytest.mark.parametrize("crowd", [500, 2])
def test_repeats_among_shuffled_passages(spark, crowd):
    rng = random.Random(5)
    passages = [prose(k, 60).split() for k in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 40)
            words += rng.choice(passages)[at:at + rng.randint(5, 40)]
            if rng.random() < 0.4:
                words.append(f"w{rng.randint(0, 5)}")
        rows.append((i if i % 17 else None, rng.choice([" ", "\n"]).join(words)))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4, crowd)
    same((tuple(r)[:4] for r in got.collect()), slow_removal(rows, 12))


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(60):
        known = [[rng.choice("abc") for _ in range(rng.randint(0, 15))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        text = [rng.choice("abcd") for _ in range(25)]
        stretches = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)}
        want = [max(n for n in range(end + 1) if n == 0 or tuple(text[end - n:end]) in stretches)
                for end in range(1, len(text) + 1)]
        assert automaton.matching_statistics(text) == want


def test_one_row_repeated_many_times(spark):
    """A list of its passages is made once, and no copy meets the list of another."""
    base = prose(1, 300).split()
    rows = [(5, " ".join(base))] * 800 + [(k, " ".join(base[:100 + k] + ["x"] + base[100 + k:])) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(docs)
    same((tuple(r)[:4] for r in got.collect()), slow_removal(rows, 50))
    assert substring._rows_once(docs).count() == 6
    assert substring._rows_once(docs.dropDuplicates()).count() == 6


@pytest.mark.parametrize("crowd", [substring.CROWD, 1])
def test_batches_are_small_however_well_texts_pack(spark, monkeypatch, crowd):
    """A task gives out what packed texts unpack to, and their windows, bit by bit."""
    bound, made = 64 << 10, common.record_batch

    def small(schema, columns):
        batch = made(schema, columns)
        held = batch.nbytes + 200 * batch.num_rows
        if "z" not in schema.names and "n" not in schema.names and held > 2 * bound:
            raise ValueError(f"{held} bytes at once")
        return batch

    monkeypatch.setattr(common, "SLICE_BYTES", bound)
    for module in (common, substring):
        monkeypatch.setattr(module, "record_batch", small)
    lines = [prose(k, 70) for k in range(30)]
    rows = [(i, " ".join([lines[i // 2 % 30], f"w{i}", *[lines[i % 30]] * 40])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = substring.remove_repeats(docs, crowd=crowd)
    same((tuple(r)[:4] for r in got.collect()), slow_removal(rows, 50))
