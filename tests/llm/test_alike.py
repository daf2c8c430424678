"""Groups of alike texts against brute force."""

import random

import numpy as np

import corpus_pipeline
from buildlens.llm import alike, simhash
from tests.llm.conftest import ODD, prose


def slow_firsts(rows):
    """The least id of each group of rows with ids, by five-word Jaccard similarity."""
    def cut(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [cut(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), alike.LAST), alike.LAST if d is None else d)
    return sorted(least.values())


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randint(0, 10 ** 6)}"
    return " ".join(words)


def planted():
    """Texts of 250 words and copies with a few words changed, around the limit too."""
    rng, rows = random.Random(11), []
    line = prose(99, 40)
    for k in range(12):
        base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(210)) + " " + line
        rows += [base] + [edited(rng, base, n) for n in (1, 3, 4, 5, 6, 9)]
    return [(i, t) for i, t in enumerate(rows)]


def test_stage_finds_copies_with_a_few_words_changed(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == slow_firsts(rows) and len(got) < len(rows) // 2
    # The digests of the query op9 alone leave most of them.
    assert simhash.one_of_each(docs).count() > len(got)


def test_large_group_of_near_copies_by_stars(spark):
    """Copies of one text, each edited: few are alike to each other, most to the middle."""
    rng, rows = random.Random(3), []
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    rows += [edited(rng, base, rng.choice([3, 4, 5, 6])) for _ in range(150)]
    rows += [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(280)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(rows)] + [(7, rows[7])] * 300 + [(None, rows[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in alike.one_of_each(docs).collect())
    assert got == slow_firsts(rows)


def test_buckets_propose_what_may_be_alike():
    sets = [alike.shingles(t) for _, t in planted()]
    bucket = alike.Bucket(list(range(len(sets))), [len(s) for s in sets], list(range(len(sets))),
                          [alike.sketch(s) for s in sets])
    got = {(int(bucket.t[i]), t) for i, o in bucket.pairs() for t in bucket.t[o].tolist()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and alike.alike(a, b)}
    assert want <= got | {(b, a) for a, b in got}
    # Stars reach every text once, and no text is far from its middle.
    centres = [(i, o) for i, o in bucket.stars()]
    assert sum(1 + len(o) for _, o in centres) == len(sets)
    assert all(alike.may_be_alike(len(sets[bucket.t[i]]) + len(sets[bucket.t[j]]), alike.sketch(sets[bucket.t[i]]),
                                  alike.sketch(sets[bucket.t[j]])) for i, o in centres for j in o.tolist())


def test_buckets_of_sketches_of_two_lengths():
    """Sets of 250 to 262 shingles: some sketches have 256 bits and some 512."""
    rng, rows = random.Random(4), []
    for _ in range(3):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(254)]
        rows += [" ".join(base[:k] + [f"x{k}"] + base[k:] + [f"e{j}" for j in range(rng.choice([0, 13]))]) for k in (20, 90, 150, 210)]
    sets = [alike.shingles(t) for t in rows]
    bucket = alike.Bucket(list(range(len(sets))), [len(s) for s in sets], list(range(len(sets))),
                          [alike.sketch(s) for s in sets])
    assert len(bucket.by_size) == 2
    met = {frozenset((int(bucket.t[i]), t)) for i, o in bucket.pairs() for t in bucket.t[o].tolist()}
    assert met >= {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if alike.alike(sets[i], sets[j])}
    assert met == {frozenset((i, j)) for i in range(len(sets)) for j in range(i)
                   if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
                   and alike.may_be_alike(len(sets[i]) + len(sets[j]), alike.sketch(sets[i]), alike.sketch(sets[j]))}
    assert sum(1 + len(o) for _, o in bucket.stars()) == len(sets)


def test_alike_texts_share_a_bucket():
    """Recall of the bands, and of the whole operator on the given texts (below)."""
    rng, met, n = random.Random(6), 0, 300
    for _ in range(n):
        words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)]
        a = np.unique(np.array([rng.getrandbits(64) for _ in words], np.uint64))
        b = np.unique(np.r_[a[:178], np.array([rng.getrandbits(64) for _ in range(22)], np.uint64)])
        met += bool(set(alike.band_keys(a).tolist()) & set(alike.band_keys(b).tolist()))
    assert met >= n - 1


def test_recall_on_the_given_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(r.doc_id for r in alike.one_of_each(docs).collect()) == slow_firsts(rows)


def test_alike_odd_rows(odd, empty):
    got = alike.one_of_each(odd)
    assert got.schema == odd.schema
    assert sorted(alike.LAST if r.doc_id is None else r.doc_id for r in got.collect()) == slow_firsts(ODD)
    assert alike.one_of_each(empty).count() == 0


def test_sketches_exclude_no_alike_texts():
    rows = [*planted(), (None, ""), (None, "a"), (None, "a b c d e f")]
    sets = [alike.shingles(t) for _, t in rows]
    for a in sets:
        for b in sets:
            if alike.alike(a, b):
                assert alike.may_be_alike(len(a) + len(b), alike.sketch(a), alike.sketch(b))
