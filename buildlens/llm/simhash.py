"""Near-duplicates by 64-bit fingerprints in a hierarchical index in Gray order.

Two fingerprints with at most two different bits agree in one of three bands. Each
fingerprint is therefore filed three times, rotated so that the band leads; a band that too
many share is cut again by three bands of its other bits. A task sorts what it got by Gray
rank below each leading pattern, so that neighbours share bits, and builds a tree: a node
keeps the bits in which all below it agree, each bit at the uppermost node that has it. A
search adds up differences on its way down and leaves a whole group once they exceed two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, slices, store, table, words
from buildlens.llm.graph import components

SHINGLE, SEED = 3, 42
DISTANCE = 2
# Leading bits and rotation of each band, and the bands of a rotated code below its leading one.
BANDS = ((22, 0), (21, 22), (21, 43))
SUB_BANDS = ((15, 21), (14, 36), (14, 50))
# Fingerprints that may share a band before it is cut again; children of a node; pairs of a
# search that a task holds at once.
CROWD, FAN, FRONTIER = 20_000, 8, 2_000_000

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None) -> int:
    """The signed 64 bits of a text; 0 if it has no words."""
    import xxhash

    found = words(text.encode().lower().decode() if text else text)
    if not found:
        return 0
    joined = b" ".join(found)
    size = xxhash.xxh64_intdigest
    if len(found) <= SHINGLE:
        hashes = [size(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1).tolist()
        hashes = [size(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at:at + (1 << 14)], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, t, fp`` of every row, by its whole text; ``t`` is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield record_batch(FINGERPRINTS, [
                part.column(0), part.column(1),
                [fingerprint(t) for t in part.column(2).to_pylist()]])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text") \
        .mapInArrow(run, "doc_id long, t long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """The tree over the codes of one task; codes meet only within their group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes = codes[self.order]
        group = group[self.order]
        new = np.r_[True, group[1:] != group[:-1]]
        start = np.flatnonzero(new)
        place = np.arange(len(codes)) - np.repeat(start, np.diff(np.r_[start, len(codes)]))
        # Levels from the single codes up to one node per group: first code, fixed bits.
        self.levels = [(np.arange(len(codes)), np.full(len(codes), ~np.uint64(0)))]
        width = 1
        while len(self.levels[-1][0]) > len(start):
            width *= FAN
            first = np.flatnonzero(new | (place % width == 0))
            ones = np.bitwise_and.reduceat(self.codes, first)
            zeros = ~np.bitwise_or.reduceat(self.codes, first)
            self.levels.append((first, ones | zeros))
        self.root = np.cumsum(new) - 1

    def links(self) -> np.ndarray:
        """For each code in order: the place of the first code it is linked to, over links."""
        label = np.arange(len(self.codes))
        todo = [np.arange(len(self.codes))]
        while todo:
            queries = todo.pop()
            found = self._search(queries)
            if found is None:
                half = len(queries) // 2
                todo += [queries[half:], queries[:half]]
            else:
                label = _merge(label, *found)
        return label

    def _search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs within the distance, each once; None if they are too many to hold at once."""
        node, differ = self.root[queries], None
        for k in range(len(self.levels) - 1, -1, -1):
            first, fixed = self.levels[k]
            if k == len(self.levels) - 1:
                new = fixed[node]
                differ = np.zeros(len(queries), np.uint8)
            else:
                above, above_fixed = self.levels[k + 1]
                lo = np.searchsorted(first, above[node])
                hi = np.searchsorted(first, np.r_[above, len(self.codes)][node + 1])
                n = hi - lo
                if n.sum() > FRONTIER and len(queries) > 1 and len(np.unique(queries)) > 1:
                    return None
                parent = np.repeat(node, n)
                node = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                queries, differ = np.repeat(queries, n), np.repeat(differ, n)
                new = fixed[node] & ~above_fixed[parent]
            bits = (self.codes[queries] ^ self.codes[first[node]]) & new
            differ = differ + np.bitwise_count(bits)
            # A pair is found from its later code, so groups that begin behind it are left.
            keep = (differ <= DISTANCE) & (first[node] <= queries)
            queries, node, differ = queries[keep], node[keep], differ[keep]
        keep = node < queries
        return queries[keep], node[keep]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def _band(code: Column, bits: int, at: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(code, at), 64 - bits)


def near_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``u, v`` that connect all of the distinct ``fp`` within the distance.

    A task gives one link at most for each fingerprint it holds, so a dense group does not
    become all its pairs.
    """
    band = F.array(*(F.struct(F.lit(i).alias("i"), _band(F.col("fp"), b, at).alias("value"))
                     for i, (b, at) in enumerate(BANDS)))
    keyed = distinct.select("fp", F.explode(band).alias("k")).select(
        "fp", "k.i", "k.value", F.lit(0).alias("j"), F.lit(0).cast("long").alias("sub"))
    crowded = store(keyed.groupBy("i", "value").count().filter(F.col("count") > crowd)
                    .select("i", "value"), "crowded")
    if crowded.head(1):
        turned = F.expr("CASE i " + " ".join(
            f"WHEN {i} THEN shiftleft(fp, {at}) | shiftrightunsigned(fp, {(64 - at) % 64})"
            if at else f"WHEN {i} THEN fp" for i, (_, at) in enumerate(BANDS)) + " END")
        # Bits 21 to 63 of a rotated code hold all bits outside its leading band.
        sub = F.array(*(F.struct(F.lit(j + 1).alias("j"), _band(F.col("t"), b, at).alias("sub"))
                        for j, (b, at) in enumerate(SUB_BANDS)))
        again = (keyed.join(crowded, ["i", "value"]).withColumn("t", turned)
                 .select("fp", "i", "value", F.explode(sub).alias("s"))
                 .select("fp", "i", "value", "s.j", "s.sub"))
        keyed = keyed.join(crowded, ["i", "value"], "left_anti").select(again.columns).union(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(b.num_rows for b in got) < 2:
            return
        got = pa.Table.from_batches(got)
        code = got["fp"].to_numpy().view(np.uint64)
        turn = np.array([at for _, at in BANDS], np.uint64)[got["i"].to_numpy()]
        rotated = np.where(turn == 0, code, code << turn | code >> (np.uint64(64) - turn) % np.uint64(64))
        keys = np.stack([got[c].to_numpy().astype(np.int64) for c in ("i", "value", "j", "sub")])
        order = np.lexsort(keys[::-1])
        changed = np.r_[False, (np.diff(keys[:, order], axis=1) != 0).any(0)]
        group = np.empty(len(code), np.int64)
        group[order] = np.cumsum(changed)
        index = GrayIndex(group, rotated)
        label = index.links()
        linked = np.flatnonzero(label != np.arange(len(label)))
        fp = code[index.order].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[linked]), pa.array(fp[label[linked]])], ["u", "v"])

    return keyed.repartition("i", "value", "j", "sub").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id, t, fp, root, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id among all documents reached over links, null only if
    all their ids are null; ``root`` names the component by its smallest fingerprint. Null
    and empty texts have fingerprint 0 and are linked like others. Repeated rows share a
    component. Other columns are left out; an empty table gives no rows.
    """
    found = store(fingerprints(docs), "fingerprints")
    least = store(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(near_links(least.select("fp"), crowd))
    rooted = least.join(linked.withColumnRenamed("node", "fp"), "fp")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id").union(
        least.join(linked, least.fp == linked.node, "left_anti")
        .select("fp", F.col("fp").alias("root"), "least"))
    return found.join(named, "fp").select("doc_id", "t", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    A null id comes after all others; of rows with the same id that of the smaller text hash,
    and of equal ids and texts one, stays.
    """
    last = F.lit((1 << 63) - 1)
    first = near_duplicates(docs, crowd).groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", last).alias("d"), F.col("t"))).alias("first"))
    keyed = docs.select(F.struct("*").alias("row"),
                        F.coalesce(F.col("doc_id").cast("long"), last).alias("d"),
                        F.xxhash64("text").alias("t"))
    return keyed.join(first.select("first.d", "first.t"), ["d", "t"], "left_semi") \
        .dropDuplicates(["d", "t"]).select("row.*")


def op9_gray_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
