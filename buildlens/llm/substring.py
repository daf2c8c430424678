"""Removal of long passages that an earlier document has, by suffix automata.

Any 50 words have an anchor, the least hash of their stretches of ten, and equal words have
equal anchors. So only passages around an anchor that two documents share can hold a repeat.
Equal passages are settled by counting. The others are dealt by anchor to shards: a shard
takes its passages in the order of their documents, streams each through the suffix
automaton of the earlier ones, and the matching statistics tell where 50 words or more were
seen before. An anchor with very many different passages is settled window by window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import batched, per_task, record_batch, slices, store, table, words

WINDOW, STRETCH = 50, 10
# Different passages of an anchor beyond which its windows are counted instead.
CROWD = 500
LAST = (1 << 63) - 1

ANCHORS_DDL = "h long, passage long, d long, t long, first int, n int"
ANCHORS = pa.schema([(n, pa.int64()) for n in ("h", "passage", "d", "t")]
                    + [(n, pa.int32()) for n in ("first", "n")])
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _stretches(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each stretch of ``k`` words."""
    n = 1 << max(12, len(hashes).bit_length())
    up, down = per_task(("powers", n), lambda: _powers(n))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:len(hashes)])])
    out = (sums[k:] - sums[:-k]) * down[:len(hashes) - k + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def anchors(found: list[bytes], window: int = WINDOW, stretch: int = STRETCH) -> tuple:
    """Of each run of windows with one anchor: its hash, the passage's, first window, windows."""
    import xxhash

    n = len(found)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    grams = _stretches(hashes, stretch)
    seen = np.lib.stride_tricks.sliding_window_view(grams, window - stretch + 1)
    place = seen.argmin(1) + np.arange(len(seen))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    passage = [
        xxhash.xxh3_64_intdigest(joined[a:b], seed=s) for a, b, s in zip(
            starts[first].tolist(), ends[first + count + window - 2].tolist(),
            (place[first] - first).tolist())
    ]
    return (grams[place[first]].view(np.int64), np.array(passage, np.uint64).view(np.int64),
            first, count)


class SuffixAutomaton:
    """All stretches of the sequences that were added."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list) -> None:
        length, link, following = self.length, self.link, self.next
        last = 0
        for symbol in sequence:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in following[p]:
                following[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = following[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
            last = new

    def matching_statistics(self, sequence: list) -> list[int]:
        """For each place: how long the longest known stretch is that ends there."""
        length, link, following = self.length, self.link, self.next
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                size = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                size += 1
            out.append(size)
        return out


def _earlier(group: list[tuple], window: int) -> Iterator[tuple]:
    """``d, t, start, stop`` of what earlier documents have, from passages of one anchor."""
    group.sort(key=lambda g: g[0])
    automaton, waiting, at = SuffixAutomaton(), [], None
    for d, t, first, text in group:
        if d != at:
            for w in waiting:
                automaton.add(w)
            waiting, at = [], d
        found = text.split(b" ")
        ends = [] if len(automaton.next) == 1 else [
            i + 1 for i, m in enumerate(automaton.matching_statistics(found)) if m >= window]
        for stop in ends:
            yield d, t, first + stop - window, first + stop
        if len(ends) <= len(found) - window:
            waiting.append(found)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _text_rows(docs: DataFrame) -> DataFrame:
    """``d, t, z``: the id (null ones last), a hash of the text, and the packed text."""
    schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            yield record_batch(schema, [part.column(0), part.column(1),
                                        [pack((t or "").encode()) for t in part.column(2).to_pylist()]])

    return docs.select(_key().alias("d"), F.xxhash64("text").alias("t"), "text") \
        .mapInArrow(run, "d long, t long, z binary")


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _anchor_rows(docs: DataFrame, window: int, stretch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = [[] for _ in ANCHORS]
            for d, t, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                found = words(text)
                if len(found) < window:
                    continue
                h, passage, first, n = anchors(found, window, stretch)
                for column, values in zip(out, (
                        h, passage, np.full(len(h), d), np.full(len(h), t), first, n)):
                    column.append(values)
            if out[0]:
                yield record_batch(ANCHORS, [
                    pa.array(np.concatenate(c), f.type) for c, f in zip(out, ANCHORS)])

    return docs.select(_key().alias("d"), F.xxhash64("text").alias("t"), "text") \
        .mapInArrow(run, ANCHORS_DDL)


def _passages(texts: DataFrame, wanted: DataFrame, window: int, single: bool) -> DataFrame:
    """``h, d, t, first, text`` of each wanted passage, or of each of its windows alone."""
    schema = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("t", pa.int64()),
                        ("first", pa.int32()), ("text", pa.binary())])

    def cut(part: pa.RecordBatch) -> Iterator[tuple]:
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for d, t, z, rows in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3)):
            found = unpack(z).split()
            for r in rows.as_py():
                first, n = r["first"], r["n"]
                if not single:
                    yield r["h"], d, t, first, b" ".join(found[first:first + n + window - 1])
                    continue
                for i in range(first, first + n):
                    h = xxhash.xxh3_64_intdigest(b" ".join(found[i:i + window]), seed=r["h"] & LAST)
                    yield h - (1 << 64) if h > LAST else h, d, t, i, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield from batched(schema, cut(part), 4)

    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("h", "first", "n")).alias("rows"))
    return texts.join(lists, ["d", "t"]).select("d", "t", "z", "rows") \
        .mapInArrow(run, "h long, d long, t long, first int, text binary")


def _search(passages: DataFrame, window: int) -> DataFrame:
    spans = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> list[tuple]:
            by: dict[tuple, list] = {}
            for d, t, a, b in _earlier(group, window):
                by.setdefault((d, t), []).append((a, b))
            return [(*k, a, b) for k, v in by.items() for a, b in _merged(v)]

        at, group, out = None, [], []
        for part in slices(batches):
            for h, *row in zip(*(c.to_pylist() for c in part.columns)):
                if h != at:
                    out += settle(group)
                    at, group = h, []
                group.append(tuple(row))
            if out:
                yield record_batch(spans, list(map(list, zip(*out))))
                out = []
        if out := settle(group):
            yield record_batch(spans, list(map(list, zip(*out))))

    return passages.repartition("h").sortWithinPartitions("h") \
        .mapInArrow(run, "d long, t long, start int, stop int")


def _rows_once(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, rows with equal ids and texts once: what they hold is found once.

    They are counted without their texts, and only those that repeat are gathered.
    """
    keyed = docs.select(_key().alias("d"), F.xxhash64("text").alias("t"), "doc_id", "text")
    again = store(keyed.groupBy("d", "t").count().filter("count > 1").select("d", "t"), "again")
    if not again.head(1):
        return docs.select("doc_id", "text")
    once = keyed.join(again, ["d", "t"]).dropDuplicates(["d", "t"])
    return keyed.join(again, ["d", "t"], "left_anti").unionByName(once).select("doc_id", "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, stretch: int = STRETCH,
                   crowd: int = CROWD) -> DataFrame:
    """``d, t, spans``: the words of each document that an earlier one has, if any.

    ``d`` is the id, ``t`` a hash of the text; ``spans`` are disjoint and sorted.
    """
    docs = _rows_once(docs)
    # Aggregates are stored before they are joined: a join on two plain shuffles is one whose
    # hot keys adaptive execution splits.
    rows = store(_anchor_rows(docs, window, stretch), "anchors")
    by_anchor = rows.groupBy("h").agg(
        F.min("d").alias("low"), F.max("d").alias("high"),
        (F.min("passage") == F.max("passage")).alias("alike"))
    shared = store(
        by_anchor.filter(F.col("low") < F.col("high")).select("h", "low", "alike"), "shared")
    live = store(
        rows.join(shared, "h").filter(~F.col("alike") | (F.col("d") > F.col("low"))), "live")
    span = (F.col("first").alias("start"), (F.col("first") + F.col("n") + window - 1).alias("stop"))
    various = live.filter(~F.col("alike"))
    first_of = store(various.groupBy("h", "passage").agg(F.min("d").alias("d0")), "firsts")
    told = store(various.join(first_of, ["h", "passage"]).drop("alike", "low"), "passages")
    covered = live.filter("alike").select("d", "t", *span).union(
        told.filter(F.col("d") > F.col("d0")).select("d", "t", *span))
    open_ = told.filter(F.col("d") == F.col("d0"))
    crowded = store(open_.groupBy("h").count().filter(F.col("count") > crowd).select("h"), "crowded")
    texts = _text_rows(docs)
    cold = open_
    if crowded.head(1):
        cold = open_.join(crowded, "h", "left_anti")
        alone = store(_passages(texts, open_.join(crowded, "h", "left_semi"), window, True)
                      .drop("text"), "windows")
        least = store(alone.groupBy("h").agg(F.min("d").alias("d0")), "least")
        covered = covered.union(
            alone.join(least, "h").filter(F.col("d") > F.col("d0"))
            .select("d", "t", F.col("first").alias("start"), (F.col("first") + window).alias("stop")))
    covered = covered.union(_search(_passages(texts, cold, window, False), window))
    return covered.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _kept(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans``; white space before a removed word goes too."""
    out, at = [], 0
    found = [m.span() for m in re.finditer("[^\\x20\\x09-\\x0D]+", text)]
    for a, b in spans:
        out.append(text[at:found[a - 1][1] if a else 0])
        at = found[b - 1][1]
    out.append(text[at:])
    return "".join(out).strip(" \t\n\x0b\x0c\r") if spans else text


def remove_repeats(docs: DataFrame, window: int = WINDOW, stretch: int = STRETCH,
                   crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``docs``.

    A word goes if ``window`` words around it also stand in a document with a smaller id. A
    null text has no words; null ids count as larger than all others and are no example for
    anything; rows with the same id do not remove each other's words. ``kept_text`` is the
    text itself where nothing goes, else what is left of it. Other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def left(part: pa.RecordBatch) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for d, z, spans in zip(*(part.column(i).to_pylist() for i in range(2)), part.column(2)):
            text = unpack(z)
            found = text.split()
            merged = _merged((s["start"], s["stop"]) for s in spans.as_py() or ())
            kept, at = [], 0
            for a, b in merged:
                kept += found[at:a]
                at = b
            kept += found[at:]
            yield (None if d == LAST else d, len(found), len(found) - len(kept),
                   hashlib.sha256(b" ".join(kept)).hexdigest(), _kept(text.decode(), merged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield from batched(schema, left(part), 4)

    spans = repeated_spans(docs, window, stretch, crowd)
    return _text_rows(docs).join(spans, ["d", "t"], "left").select("d", "z", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def without_repeats(docs: DataFrame, window: int = WINDOW, stretch: int = STRETCH,
                    crowd: int = CROWD) -> DataFrame:
    """All rows with all their columns; ``text`` and ``n_chars`` are of what is left."""
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = part.column(part.num_columns - 1).to_pylist()
            part = part.select(range(part.num_columns - 1))
            if any(spans):
                texts = [
                    _kept(t, _merged((s["start"], s["stop"]) for s in x)) if x else t
                    for t, x in zip(part.column(text_at).to_pylist(), spans)]
                part = part.set_column(text_at, part.schema.field(text_at), pa.array(texts, pa.string()))
                if chars_at is not None:
                    size = pc.cast(pc.utf8_length(part.column(text_at)), pa.int64())
                    size = pc.if_else(pa.array(list(map(bool, spans))), size, part.column(chars_at))
                    part = part.set_column(chars_at, part.schema.field(chars_at), size)
            yield part

    spans = repeated_spans(docs, window, stretch, crowd)
    keyed = docs.select(F.struct("*").alias("row"), _key().alias("d"), F.xxhash64("text").alias("t"))
    return keyed.join(spans, ["d", "t"], "left").select("row.*", F.col("spans").alias("_spans_")) \
        .mapInArrow(run, docs.schema)


def op5_suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept_text")
