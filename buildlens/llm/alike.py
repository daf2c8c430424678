"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Links are proposed twice and kept only where the whole sets are alike. First the Gray-order
index over fingerprints of the five-word shingles gives spanning links between texts of
nearly equal fingerprints. Then texts meet in buckets, one for each of 32 bands of six least
hashes; two texts of similarity 0.8 share a bucket with a probability of 0.99994, more
alike ones with a larger one, and texts that share a passage only rarely do. A bucket
proposes stars around its middle text, which alike texts join as members of one group. At
last buckets whose texts are still of several groups propose all pairs of different groups
that their sketches do not exclude, so that nothing that meets is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm import simhash
from buildlens.llm.common import record_batch, slices, store, words
from buildlens.llm.graph import components
from buildlens.llm.substring import _stretches

SHINGLE = 5
BANDS, LEAST = 32, 6
# Rows and pairs that a task handles at once, sets it remembers.
CHUNK, SETS = 1 << 15, 256
LAST = (1 << 63) - 1

ROWS = pa.schema([("d", pa.int64()), ("x", pa.int64()), ("t", pa.int64()), ("n", pa.int32()),
                  ("fp", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary())])
MEETINGS = pa.schema([("h", pa.int64()), ("t", pa.int64())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the stretches of five words, ASCII letters as small ones.

    Of fewer words it is one hash of all, of none nothing.
    """
    import xxhash

    found = words(text.encode().lower().decode() if text else text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(found) < SHINGLE:
        # Apart from the shingles of longer texts.
        hashes += np.uint64(len(found))
    return np.unique(_stretches(hashes, min(SHINGLE, len(found))))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is 0.8 or more; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(found: np.ndarray) -> bytes:
    """Of each of at least as many bins as shingles: whether it holds an odd number of them."""
    bins = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) & bins - 1, minlength=bins) & 1).tobytes()


def may_be_alike(n: int, a: bytes, b: bytes) -> bool:
    """False only if two sets of ``n`` shingles together, with these sketches, cannot be alike.

    Each odd bin of the difference holds a shingle that one set lacks, and of alike sets
    those are at most a ninth of all.
    """
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), 0) for x in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n


def fingerprint(found: np.ndarray) -> int:
    """The signed 64 bits of a set of shingles; 0 if it is empty."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(found), bitorder="little").view("<i8")[0]) if len(found) else 0


def _factors(n: int) -> np.ndarray:
    """Odd numbers, spread over 64 bits."""
    out = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32) | np.uint64(1)


FACTORS = _factors(BANDS * LEAST)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash for each band: of the least of the set under each of its hash functions."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(found), CHUNK // 64):
        part = found[at:at + CHUNK // 64, None] * FACTORS
        part ^= part >> np.uint64(31)
        least = np.minimum(least, (part * np.uint64(0x94D049BB133111EB)).min(0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, LEAST).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """``d, x, t, n, fp, sketch, keys`` of every row.

    The id (a null one is the last), a hash of the text, a hash of its set of shingles, and
    what the set amounts to; that is null where the task has told it of an equal text.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for part in slices(batches):
            rows = []
            for d, x, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                if x in seen:
                    rows.append((d, x, seen[x], None, None, None, None))
                    continue
                found = shingles(text)
                t = xxhash.xxh3_64_intdigest(found.tobytes())
                seen[x] = t = t - (1 << 64) if t > LAST else t
                rows.append((d, x, t, len(found), fingerprint(found), sketch(found), band_keys(found).tobytes()))
            yield record_batch(ROWS, list(map(list, zip(*rows))) if rows else [[] for _ in ROWS])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
                       F.xxhash64("text").alias("x"), "text") \
        .mapInArrow(run, "d long, x long, t long, n int, fp long, sketch binary, keys binary")


def _meetings(sets: DataFrame) -> DataFrame:
    """``h, t`` of texts that share the bucket ``h`` with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            yield record_batch(MEETINGS, [pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))])

    rows = store(sets.filter("n > 0").select("t", "keys").mapInArrow(run, "h long, t long"), "bands")
    several = rows.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a < b").select("h")
    return rows.join(store(several, "several"), "h")


def _fold(rows: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(rows.reshape(len(rows), rows.shape[1] // size, size), 1)


class Bucket:
    """The texts of a bucket: names, sizes, groups so far, sketches."""

    def __init__(self, t: list, n: list, root: list, sketches: list):
        order = sorted(range(len(t)), key=lambda i: (n[i], t[i]))
        self.t = np.array([t[i] for i in order], np.int64)
        self.n = np.array([n[i] for i in order], np.int64)
        self.root = np.array([root[i] for i in order], np.int64)
        # Larger sets have longer sketches, so equal lengths are adjacent.
        data = [sketches[i] for i in order]
        self.size = np.array([len(s) for s in data])
        self.by_size = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.by_size[size] = (int(at[0]), np.frombuffer(b"".join(data[at[0]:at[-1] + 1]), np.uint8).reshape(-1, size))

    def near(self, i: int) -> np.ndarray:
        """Which texts may be alike to the one at place ``i``, by size and sketch."""
        out = np.zeros(len(self.t), bool)
        own = int(self.size[i])
        start, rows = self.by_size[own]
        mine = rows[i - start]
        lo = np.searchsorted(5 * self.n, 4 * self.n[i], "left")
        hi = np.searchsorted(4 * self.n, 5 * self.n[i], "right")
        for size, (start, rows) in self.by_size.items():
            a, b = max(lo - start, 0), min(hi - start, len(rows))
            low = min(size, own)
            for at in range(a, b, CHUNK):
                part = rows[at:min(at + CHUNK, b)]
                odd = np.bitwise_count(_fold(part, low) ^ _fold(mine[None], low)).sum(1, dtype=np.int64)
                out[start + at:start + at + len(part)] = 9 * odd <= self.n[start + at:start + at + len(part)] + self.n[i]
        return out

    def middle(self, left: np.ndarray) -> int:
        """The text nearest to what most of the sketches of those left have in common."""
        size = int(self.size[left].min())
        rows = np.concatenate([_fold(r[left[s:s + len(r)]], size) for s, r in self.by_size.values()])
        count = np.zeros(8 * size, np.int64)
        for at in range(0, len(rows), CHUNK):
            count += np.unpackbits(rows[at:at + CHUNK], axis=1).sum(0, dtype=np.int64)
        most = np.packbits(2 * count > len(rows))
        return int(np.flatnonzero(left)[np.bitwise_count(rows ^ most).sum(1, dtype=np.int64).argmin()])

    def stars(self) -> Iterator[tuple[int, np.ndarray]]:
        """A middle text and those of other groups that may be alike to it, until all were in a star."""
        left = np.ones(len(self.t), bool)
        while left.any():
            i = self.middle(left)
            near = self.near(i) & left
            near[i] = True
            left &= ~near
            yield i, np.flatnonzero(near & (self.root != self.root[i]))

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each text and those behind it, of other groups, that may be alike to it."""
        for i in range(len(self.t) - 1):
            near = self.near(i)
            near[:i + 1] = False
            yield i, np.flatnonzero(near & (self.root != self.root[i]))


def _proposed(met: DataFrame, sets: DataFrame, root: DataFrame | None = None) -> DataFrame:
    """``u, v``: distinct pairs that buckets propose.

    Stars without ``root``; with it all pairs of texts of different groups.
    """
    stars = root is None
    if stars:
        rows = met.withColumn("r", F.col("t"))
    else:
        # Buckets of one group have nothing left to say; the others are few.
        named = store(met.join(root, met.t == root.node, "left")
                      .select("h", "t", F.coalesce("root", "t").alias("r")), "rooted")
        open_ = named.groupBy("h").agg(F.min("r").alias("a"), F.max("r").alias("b")).filter("a < b").select("h")
        rows = named.join(store(open_, "open"), "h")
    rows = rows.join(sets, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proposals(rows: list[tuple]) -> list[tuple]:
            bucket = Bucket(*zip(*rows))
            out = []
            for i, others in bucket.stars() if stars else bucket.pairs():
                own = int(bucket.t[i])
                out += [(min(own, t), max(own, t)) for t in bucket.t[others].tolist()]
            return out

        at, rows = None, {}
        for part in slices(batches):
            pairs = []
            for h, t, *row in zip(*(c.to_pylist() for c in part.columns)):
                if h != at:
                    if len(rows) > 1:
                        pairs += proposals([(t, *r) for t, r in rows.items()])
                    at, rows = h, {}
                rows[t] = (row[0], row[1], row[2])
            if pairs:
                yield record_batch(LINKS, list(map(list, zip(*pairs))))
        if len(rows) > 1 and (pairs := proposals([(t, *r) for t, r in rows.items()])):
            yield record_batch(LINKS, list(map(list, zip(*pairs))))

    return rows.select("h", "t", "n", "r", "sketch").repartition("h").sortWithinPartitions("h") \
        .mapInArrow(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``u, v`` whose texts are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(t: int, text: str) -> np.ndarray:
            if t not in kept:
                if len(kept) >= SETS or sum(map(len, kept.values())) > 1 << 22:
                    kept.clear()
                kept[t] = shingles(text)
            return kept[t]

        for part in slices(batches):
            keep = [alike(of(v, b), of(u, a)) for u, v, a, b in zip(*(part.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1)], schema=LINKS).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("t").alias(c), F.col("text").alias(f"{c}_text")) for c in "uv")
    return pairs.join(left, "u").join(right, "v") \
        .select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """``u, v``: spanning pairs of texts whose fingerprints are linked by the Gray-order index."""
    first = store(sets.groupBy("fp").agg(F.min("t").alias("first")), "fingerprints")
    same = sets.join(first, "fp").filter("t > first").select(F.col("first").alias("u"), F.col("t").alias("v"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_t")) for c in "uv")
    near = simhash.near_links(first.select("fp")).join(a, "u").join(b, "v") \
        .select(F.least("u_t", "v_t").alias("u"), F.greatest("u_t", "v_t").alias("v"))
    return near.union(same).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``d, x, root`` of every row: its id (a null one is the last), a hash of its text, its group.

    The group of texts that are reached over links is named by one of them. Texts with equal
    sets of shingles are one, so those without words are one group; repeated rows share it.
    """
    rows = store(_sets(docs), "sets")
    sets = store(
        rows.filter("keys IS NOT NULL").groupBy("t").agg(F.min(F.struct("d", "x", "n", "fp", "sketch", "keys")).alias("s"))
        .select("t", "s.*"), "different")
    met = store(_meetings(sets), "met")
    first = store(_by_fingerprint(sets), "proposed")
    need = store(met.select("t").union(first.select("u")).union(first.select("v")).distinct()
                 .join(sets, "t").select("t", "d", "x"), "needed")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
                        F.xxhash64("text").alias("x"), "text")
    texts = store(keyed.join(need, ["d", "x"]).select("t", "text").dropDuplicates(["t"]), "texts")
    met_sets = store(sets.join(met.select("t").distinct(), "t").select("t", "n", "sketch"), "sketches")
    tested = store(first.union(_proposed(met, met_sets)).distinct(), "stars")
    links = store(_verified(tested, texts), "links")
    root = store(components(links), "roots")
    more = store(_proposed(met, met_sets, root).join(tested, ["u", "v"], "left_anti"), "pairs")
    found = store(_verified(more, texts), "links")
    if found.head(1):
        root = store(components(links.union(found)), "roots")
    return rows.join(root, rows.t == root.node, "left").select("d", "x", F.coalesce("root", "t").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of alike texts, with all its columns: that of the smallest id.

    Texts without words are one group. A null id comes after all others; of rows with the
    same id that of the smaller text hash, and of equal ids and texts one, stays.
    """
    first = groups(docs).groupBy("root").agg(F.min(F.struct("d", "x")).alias("first"))
    keyed = docs.select(F.struct("*").alias("row"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
                        F.xxhash64("text").alias("x"))
    return keyed.join(first.select("first.d", "first.x"), ["d", "x"], "left_semi") \
        .dropDuplicates(["d", "x"]).select("row.*")
