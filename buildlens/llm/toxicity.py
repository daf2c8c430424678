"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a hashed linear model
over its words and their beginnings, and the document is toxic unless every
sentence is harmless: the sentences are combined by noisy-or. Labels exist for documents
only; the gradient of the noisy-or passes them on to the sentences, which afterwards tell
where the offence stands.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, remainder, slices, store, table

# Bound of the sample that is learned from; a task learns from at least so many rows of it.
SAMPLE, PART = 16_000, 2_500
# Longer texts are scored like all others, but not learned from.
TEACHING_CHARS = 1 << 20
BUCKETS = 1 << 18
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 2, 6, 32, 0.3, 1e-5
START = -6.0
THRESHOLD, SPAN_THRESHOLD = 0.3, 0.3
REMEMBERED = 300_000

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()),
                                  ("score", pa.float64())]))),
])
DDL = "doc_id long, score double, spans array<struct<start int, stop int, score double>>"
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>-"


def features(word: str) -> np.ndarray:
    """Buckets of a word: the word and its beginnings of three to five characters."""
    word = word.strip(_EDGES).lower()
    if not word:
        return np.zeros(0, np.int64)
    found = {f"w{word}", *(f"p{word[:n]}" for n in (3, 4, 5) if len(word) > n)}
    return np.array(sorted(zlib.crc32(f.encode()) % BUCKETS for f in found), np.int64)


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


class Bags:
    """Labelled documents as flat arrays of buckets, with the sentence and document of each."""

    def __init__(self, rows: list[tuple[str | None, int]]):
        known: dict[str, np.ndarray] = {}
        self.batches = []
        for at in range(0, len(rows), BATCH):
            flat, counts, per_doc, labels = [], [], [], []
            for text, label in rows[at:at + BATCH]:
                spans = sentences(text or "")
                if not spans:
                    continue
                for a, b in spans:
                    found = []
                    for w in text[a:b].split():
                        f = known.get(w)
                        if f is None:
                            f = known[w] = features(w)
                        found.append(f)
                    f = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                    flat.append(f.astype(np.int32))
                    counts.append(len(f))
                per_doc.append(len(spans))
                labels.append(label)
            if labels:
                n = len(counts)
                self.batches.append((
                    np.concatenate(flat), np.repeat(np.arange(n), counts), n,
                    np.repeat(np.arange(len(labels)), per_doc), np.array(labels, float)))

    def learn(self, w: np.ndarray, square: np.ndarray, epochs: int) -> None:
        """AdaGrad on the likelihood of the labels; ``w[BUCKETS]`` is the common start."""
        for _ in range(epochs):
            for flat, sentence, n, doc, label in self.batches:
                z = w[BUCKETS] + np.bincount(sentence, w[flat], n)
                p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
                clean = np.bincount(doc, np.log1p(-p))
                any_ = np.clip(-np.expm1(clean), 1e-6, 1)
                pull = np.where(label == 1, (1 - any_) / any_, -1.0)
                slope = p * pull[doc]
                grad = np.bincount(flat, slope[sentence], BUCKETS + 1) / len(label)
                grad[BUCKETS] = slope.sum() / len(label)
                touched = np.flatnonzero(grad)
                g = grad[touched] - DECAY * w[touched]
                square[touched] += g * g
                w[touched] += RATE * g / np.sqrt(square[touched] + 1e-8)


def fit(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from ``text, toxic`` of at most ``sample`` rows.

    Each round, every part of the sample learns by itself from the common weights, and a
    weight becomes the mean over the parts that moved it. Rows without a label are left out;
    without rows the weights stay at their start.
    """
    spark = labelled.sparkSession
    w = np.zeros(BUCKETS + 1)
    w[BUCKETS] = START
    parts = max(1, sample // PART)
    stored = store(labelled.filter(F.col("toxic").isNotNull())
                   .select("text", F.col("toxic").cast("int").alias("toxic"))
                   .repartition(parts), "toxicity")
    # Files hold equal shares in any order of rows, so a few of them are a fair part.
    parts = min(parts, max(1, stored.count() // PART))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            rows.sort(key=lambda r: hashlib.md5((r[0] or "").encode()).digest())
            own, square = sent.value.copy(), np.full(BUCKETS + 1, 1e-2)
            bags = Bags(rows)
            if bags.batches:
                bags.learn(own, square, EPOCHS)
                yield pa.RecordBatch.from_arrays([pa.array([(own - sent.value).tobytes()])], ["d"])

        moves = [np.frombuffer(r.d) for r in
                 stored.coalesce(parts).mapInArrow(run, "d binary").collect()]
        if moves:
            moved = sum((m != 0).astype(float) for m in moves)
            w = w + sum(moves) / np.maximum(moved, 1)
    return w


class Scorer:
    def __init__(self, w: np.ndarray):
        self.w, self.start, self.known = w, float(w[BUCKETS]), {}

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The noisy-or of the sentences of a text, and those at or above the threshold."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, w, clean, spans = self.known, self.w, 0.0, []
        for a, b in sentences(text or ""):
            z = self.start
            for word in set(text[a:b].split()):
                v = known.get(word)
                if v is None:
                    v = known[word] = float(w[features(word)].sum())
                z += v
            p = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
            clean += float(np.log1p(-p))
            if p >= SPAN_THRESHOLD:
                spans.append({"start": a, "stop": b, "score": float(p)})
        return float(-np.expm1(clean)), spans


def score_documents(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """``doc_id, score, spans`` for every row, by its whole text.

    ``spans`` are the sentences that offend, as places in the text. A text that is null or
    has no sentence scores 0. Nothing is shuffled; repeated rows score alike, null ids stay,
    other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(sent.value)
        for part in slices(batches):
            found = [own.score(t) for t in part.column(1).to_pylist()]
            yield record_batch(SCHEMA, [part.column(0), [s for s, _ in found], [x for _, x in found]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most ``sample`` labelled ids that are not held out.

    Ids are chosen by hash; an id with several labels is toxic if one of them is, and of an
    id with several texts one counts. Texts over ``TEACHING_CHARS`` are not learned from, so
    the sample is bounded in rows and in bytes.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & (remainder("doc_id", 4) != 2))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .filter(F.coalesce(F.length("text"), F.lit(0)) <= TEACHING_CHARS)
    # The sample is small, so repeated rows of its ids meet as one row each.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id") \
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def op1_sentence_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = score_documents(docs, fit(labelled_sample(docs, labels)))
    return found.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
