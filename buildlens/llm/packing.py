"""Best-fit-decreasing packing with certified bin counts.

Documents are dealt over partitions, each of which packs its own by best-fit decreasing and
proves with dual-feasible functions how few sequences any packing of them needs. Partitions
that use more than the bound, and the emptiest sequence of every partition, give their
documents up; those are dealt anew over fewer partitions and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, slices, store, table
from buildlens.llm.tokens import library_encoder, vocabulary_text

CAPACITY = 2048
# Pieces that one task packs, and rounds of exchange.
PARTITION_PIECES, ROUNDS = 50_000, 4
END = 0

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_DDL = f"{PIECES_DDL}, sequence_id long, offset long, open boolean"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of two families of dual-feasible functions, in whole numbers.

    The first drops lengths below a threshold and counts those above its complement as
    whole; the second rounds ``(k + 1) x / capacity`` down to parts of ``k``.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    whole = np.cumsum(count[::-1])[::-1]
    mass = np.cumsum(count * size)
    best = -(-int(mass[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        above = int(whole[capacity - t + 1])
        between = int(mass[capacity - t] - mass[t - 1])
        best = max(best, -(-(above * capacity + between) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # In units of 1 / (k * capacity): x stays x where (k + 1) x is whole.
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length; the fullest bin with room takes the next one."""
    bins = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY,
                  end: int = END) -> DataFrame:
    """Tokens of whole texts, the end id after each, cut into pieces of ``capacity``.

    Only the first piece may be shorter. A null text is empty and gives one piece with the
    end id alone; null ids and repeated rows keep their pieces; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(sent.value)
        for part in slices(batches):
            flat, ends = coder.many(part.column(1))
            at, out = 0, []
            for doc_id, stop in zip(part.column(0).to_pylist(), ends.tolist()):
                ids = memoryview(np.append(flat[at:stop], np.uint32(end))).cast("B")
                n, at = stop - at + 1, stop
                cut, piece, start = (n - 1) % capacity + 1, 0, 0
                while start < n:
                    out.append((doc_id, piece, start, cut - start, zlib.crc32(ids[4 * start:4 * cut])))
                    start, cut, piece = cut, cut + capacity, piece + 1
            yield record_batch(PIECES, list(map(list, zip(*out))))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_DDL)


def _pack_group(round_: int, last: bool, capacity: int):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) > lower_bound(lengths, capacity)
        given = (fill < capacity) if gap else np.arange(len(fill)) == fill.argmin()
        order = np.argsort(bins, kind="stable")
        placed = np.cumsum(lengths[order])
        first = np.searchsorted(bins[order], np.arange(len(fill)))
        offset = np.empty(len(bins), np.int64)
        offset[order] = placed - lengths[order] - (placed - lengths[order])[first[bins[order]]]
        name = (np.int64(round_) << 56) + (np.int64(key[0].as_py()) << 28) + bins
        out = rows.select(PIECES.names)
        for column, values in (("sequence_id", name), ("offset", offset),
                               ("open", given[bins] & (not last))):
            out = out.append_column(column, pa.array(values))
        return out

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    A piece of full length is a sequence by itself. The rest is dealt over partitions row by
    row, whatever its ids, so no document, length or copy can crowd one of them. ``pieces``
    must give its rows in the same order each time, as stored files do.
    """
    number = F.monotonically_increasing_id()
    done = [
        pieces.filter(F.col("length") == capacity)
        .select("*", (-1 - number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ]
    rest = pieces.filter(F.col("length") < capacity)
    before = None
    for r in range(rounds):
        n = rest.count()
        if not n:
            break
        groups = -(-n // partition_pieces)
        # One group has nobody to exchange with, and a round that closed little was the last.
        last = groups == 1 or r == rounds - 1 or (before is not None and n > 0.9 * before)
        packed = store(
            rest.withColumn("g", F.pmod(F.xxhash64(number), F.lit(groups)))
            .groupBy("g").applyInArrow(_pack_group(r, last, capacity), PACKED_DDL), f"packed-{r}")
        done.append(packed.filter(~F.col("open")).drop("open"))
        if last:
            break
        rest, before = packed.filter("open").select(PIECES.names), n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack the texts of ``docs``; an empty table gives no pieces."""
    return pack_pieces(store(cut_documents(docs, vocabulary, capacity), "pieces"), capacity)


def op8_certified_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = vocabulary_text(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(table(spark, folder, "documents"), vocabulary)
