"""Token ids in Simple-8b words, in a file that can be read from any document on.

A word of 64 bits holds a selector in its upper four bits and as many ids as it can of
the selector's width below. An id of 60 bits or more is an escape: its word holds the
place of the id in the block's list of escaped ids. A document begins at a new word, and a
block lists the first word of each of its documents, so that numpy decodes all words of one
selector at once, and a single document without the others.

The file is a Parquet folder of blocks: Spark commits it, on any store, whole or not at
all. A block holds whole documents, at least ``BLOCK_IDS`` ids unless it is the last of its
shard, and shards follow each other in the order of ``doc_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, scratch, slices, table
from buildlens.llm.tokens import library_encoder, vocabulary_text

# Ids of a word and bits of an id, by selector; 0 is the escape, 1 is unused.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK_IDS = 1 << 17
END = 0

BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("word_at", pa.list_(pa.int64())), ("escaped", pa.binary()), ("words", pa.binary()),
])
BLOCKS_DDL = ("shard int, block long, first long, n_ids long, doc_ids array<long>, "
              "lengths array<long>, word_at array<long>, escaped binary, words binary")
DOCS = pa.schema([
    ("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()),
])
DOCS_DDL = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"


def _class(ids: np.ndarray) -> np.ndarray:
    """The selector with the narrowest width that holds each id, counted from the narrow end."""
    limits = np.uint64(1) << BITS[2:].astype(np.uint64)
    if len(ids) and ids.max() < 1 << 16:
        small = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), "right")
        return small.astype(np.uint8)[ids.astype(np.int64)]
    return np.searchsorted(limits, ids, "right").astype(np.uint8)


def _widest(classes: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of a selector: the widest class among so many ids from a place on."""
    def with_later(m: np.ndarray, by: int) -> np.ndarray:
        out = m.copy()
        np.maximum(m[:-by], m[by:], out=out[:-by])
        return out

    m = {1: classes}
    for count, from_, by in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3),
                             (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (16, 8, 8),
                             (20, 16, 4), (30, 16, 14), (32, 16, 16), (60, 32, 28)):
        m[count] = with_later(m[from_], by)
    return m


def encode(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each document, and the escaped ids.

    Each word takes as many of the next ids as fit; a document's last word may have room.
    """
    ids = ids.astype(np.uint64)
    # Zeros behind each document, as many as a word can hold: no word reaches the next one.
    gap = int(COUNTS.max())
    at = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
    values = np.zeros(len(ids) + len(lengths) * gap + 1, np.uint64)
    values[at] = ids
    classes = _class(values)
    escaped = values[classes == 14]
    chosen = np.zeros(len(values), np.uint8)
    widest = _widest(classes)
    for s in range(15, 1, -1):  # narrower ones later: the last that fits stays
        chosen[widest[int(COUNTS[s])] <= s - 2] = s
    step = COUNTS[chosen].astype(np.uint8).tobytes()
    stops = np.cumsum(lengths + gap) - gap
    starts, word_at = [], []
    for here, stop in zip((stops - lengths).tolist(), stops.tolist()):
        word_at.append(len(starts))
        while here < stop:
            starts.append(here)
            here += step[here]
    starts = np.array(starts, np.int64)
    picked = chosen[starts].astype(np.int64)
    out = picked.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(picked == s)
        if len(rows):
            first, word = starts[rows], out[rows]
            for j in range(int(COUNTS[s])):
                word |= values[first + j] << np.uint64(j * BITS[s])
            out[rows] = word
    out[picked == 0] = np.arange(len(escaped), dtype=np.uint64)
    return out, np.array(word_at, np.int64), escaped


def decode(words: np.ndarray, word_at: np.ndarray, lengths: np.ndarray,
           escaped: np.ndarray) -> np.ndarray:
    """All ids of a block, one selector at a time."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[picked]
    before = np.cumsum(count) - count
    ends = np.cumsum(lengths)
    per_doc = np.diff(np.append(word_at, len(words)))
    full = per_doc > 0
    shift = np.repeat((ends - lengths)[full] - before[word_at[full]], per_doc[full])
    first, limit = before + shift, np.repeat(ends[full], per_doc[full])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(picked == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s]) if len(rows) else 0):
            to = first[rows] + j
            keep = to < limit[rows]
            out[to[keep]] = words[rows[keep]] >> np.uint64(j * BITS[s]) & mask
    rows = np.flatnonzero(picked == 0)
    if len(rows):
        out[first[rows]] = escaped[words[rows].astype(np.int64)]
    return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Tokenise whole texts, append ``end`` to each, and write them in the order of ``doc_id``.

    A null text is empty, a null id comes first, and rows with the same id follow each other
    in the order of their texts' hashes. Other columns are left out; an empty table gives a
    file without blocks. The rows are dealt by ranges of (id, hash of the text), so many
    rows of one id spread over shards.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(sent.value)
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        doc_ids, lengths, ids = [], [], []

        def cut() -> pa.RecordBatch:
            nonlocal block, first
            flat, sizes = np.concatenate(ids), np.array(lengths, np.int64)
            words, word_at, escaped = encode(flat, sizes)
            out = record_batch(BLOCKS, [
                [shard], [block], [first], [len(flat)], [list(doc_ids)], [sizes], [word_at],
                [escaped.astype("<u8").tobytes()], [words.astype("<u8").tobytes()]])
            block, first = block + 1, first + len(flat)
            doc_ids.clear(), lengths.clear(), ids.clear()
            return out

        waiting = 0
        for part in slices(batches):
            flat, ends = coder.many(part.column(1))
            at = 0
            for doc_id, stop in zip(part.column(0).to_pylist(), ends.tolist()):
                doc_ids.append(doc_id)
                lengths.append(stop - at + 1)
                ids.append(np.append(flat[at:stop], np.uint32(end)))
                waiting += stop - at + 1
                at = stop
                if waiting >= BLOCK_IDS:
                    waiting = 0
                    yield cut()
        if ids:
            yield cut()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h"]
    (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
     .repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, BLOCKS_DDL)
     .write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, shard, at, n_tokens, ids_crc32`` of every document in the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = decode(np.frombuffer(row["words"], "<u8"),
                             np.array(row["word_at"], np.int64), lengths,
                             np.frombuffer(row["escaped"], "<u8")).astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), row["lengths"])]
                yield record_batch(DOCS, [
                    row["doc_ids"], [row["shard"]] * len(crc), row["first"] + ends - lengths,
                    lengths, crc])

    return spark.read.schema(BLOCKS_DDL).parquet(path).mapInArrow(run, DOCS_DDL)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, before``: the ids of all earlier shards. One row per shard, so few rows."""
    totals = spark.read.schema(BLOCKS_DDL).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before, out = 0, []
    for row in sorted(totals.collect()):
        out.append((row.shard, before))
        before += row.n
    return spark.createDataFrame(out, "shard int, before long")


def op6_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    vocabulary = vocabulary_text(public_tokenizers.path("byte_bpe_50k.json"))
    write_tokens(table(spark, folder, "documents"), path, vocabulary)
    return (
        read_tokens(spark, path).join(F.broadcast(read_starts(spark, path)), "shard")
        .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
