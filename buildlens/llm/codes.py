"""Compression of vectors to codes, with norm-of-sum bounds.

A vector is cut into parts, each part is coded by the nearest entry of that part's codebook,
and codebooks are refined in rounds. Each part of each vector keeps a lower bound on its
distance to all entries but its own, with the round it was measured in. The history of the
codebooks is kept, so the bound shrinks by how far an entry has truly come since that round,
which is never more than the sum of its steps. Only where the exact distance to the own entry
is not below the bound all entries are measured again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, store, table
from buildlens.llm.integers import check_sizes, floors, matrix, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
# Different lengths of vectors, each with codebooks of its own.
LENGTHS = 64
LAST = (1 << 63) - 1

STATE = pa.schema([("code", pa.binary()), ("bound", pa.binary()), ("stamp", pa.binary())])
SUMS = pa.schema([(n, pa.int32()) for n in ("dim", "part", "entry", "place")]
                 + [("n", pa.int64()), ("total", pa.int64())])


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin and end; they are equal if the length can be divided."""
    return [dim * p // parts for p in range(parts + 1)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for place in range(x.shape[1]):
        step = x[:, place, None] - entries[None, :, place]
        out += step * step
    return out


class Bounds:
    """The codes of some parts in this round, from what is known of earlier rounds.

    ``history`` has one part's codebook of every round, the present one last.
    """

    def __init__(self, history: list[np.ndarray]):
        self.now, self.round = history[-1], len(history) - 1
        k = len(self.now)
        # By round and own entry: how far any other entry has come since then.
        self.moved = np.zeros((len(history), k))
        for r, then in enumerate(history):
            net = np.sqrt(((self.now - then).astype(np.float64) ** 2).sum(1))
            order = np.argsort(-net, kind="stable")
            self.moved[r] = net[order[0]]
            self.moved[r, order[0]] = net[order[1]] if k > 1 else 0.0
        self.moved *= 1 + 1e-9

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple:
        """New codes, bounds, stamps, exact squared distances, and which rows were measured again."""
        own = ((x - self.now[code]) ** 2).sum(1)
        # Strictly below: another entry at the same distance may have a lower index.
        left = bound.astype(np.float64) * (1 - 1e-6) - self.moved[stamp, code]
        again = ~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) < left)
        code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
        if again.any():
            code[again], bound[again], own[again] = self.measure(x[again])
            stamp[again] = self.round
        return code, bound, stamp, own, again

    def measure(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row, a bound for the others, the exact squared distance."""
        d = distances(x, self.now)
        rows, code = np.arange(len(x)), d.argmin(1)
        own = d[rows, code]
        d[rows, code] = LAST
        other = d.min(1)
        bound = np.where(other == LAST, np.inf, np.sqrt(other.astype(np.float64))).astype(np.float32)
        return code.astype(np.uint8), bound, own


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _rounds(batch: pa.RecordBatch, dim: int, at: np.ndarray, history: list[dict], parts: int, known: bool) -> tuple:
    """Codes, bounds, stamps (each by row and part) and errors of the rows ``at``."""
    x = matrix(batch.column("v").take(pa.array(at)), dim)
    edge = cuts(dim, parts)
    n = len(at)
    code, bound, stamp = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.uint8)
    if known:
        for out, name in ((code, "code"), (bound, "bound"), (stamp, "stamp")):
            data = b"".join(batch.column(name).take(pa.array(at)).to_pylist())
            out[:] = np.frombuffer(data, out.dtype).reshape(n, parts)
    error = np.zeros(n, np.int64)
    for p in range(parts):
        own = x[:, edge[p]:edge[p + 1]]
        books = Bounds([h[dim][p] for h in history])
        if known:
            code[:, p], bound[:, p], stamp[:, p], d, _ = books.assign(own, code[:, p], bound[:, p], stamp[:, p])
        else:
            code[:, p], bound[:, p], d = books.measure(own)
        error += d
    return code, bound, stamp, error


def _assigned(rows: DataFrame, history: list[dict], parts: int) -> DataFrame:
    """The rows with the codes, bounds and stamps of the present round."""
    known = "code" in rows.columns
    base = [c for c in rows.columns if c not in STATE.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[None] * batch.num_rows for _ in STATE]
            for dim, at in _by_length(batch):
                code, bound, stamp, _ = _rounds(batch, dim, at, history, parts, known)
                for i, c, b, s in zip(at.tolist(), code, bound, stamp):
                    out[0][i], out[1][i], out[2][i] = c.tobytes(), b.tobytes(), s.tobytes()
            state = record_batch(STATE, out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in base] + state.columns, [*base, *STATE.names])

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in base)
    return rows.mapInArrow(run, f"{ddl}, code binary, bound binary, stamp binary")


def _sums(rows: DataFrame, parts: int) -> list:
    """Counts and sums of the components that each entry stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            for dim, at in _by_length(batch):
                x = matrix(batch.column("v").take(pa.array(at)), dim)
                code = np.frombuffer(b"".join(batch.column("code").take(pa.array(at)).to_pylist()), np.uint8)
                code, edge = code.reshape(len(at), parts), cuts(dim, parts)
                n, total = kept.setdefault(dim, (np.zeros((parts, 256), np.int64), np.zeros((dim, 256), np.int64)))
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=256)
                    for c in range(edge[p], edge[p + 1]):
                        np.add.at(total[c], code[:, p], x[:, c])
        for dim, (n, total) in kept.items():
            for p, (a, b) in enumerate(zip(cuts(dim, parts), cuts(dim, parts)[1:])):
                for c in range(a, b):
                    entry = np.flatnonzero(n[p])
                    same = [np.full(len(entry), i, np.int32) for i in (dim, p)]
                    yield record_batch(SUMS, [*map(pa.array, same), pa.array(entry.astype(np.int32)),
                                              pa.array(np.full(len(entry), c - a, np.int32)),
                                              pa.array(n[p][entry]), pa.array(total[c][entry])])

    return rows.select("dim", "v", "code").mapInArrow(run, "dim int, part int, entry int, place int, n long, total long") \
        .groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def _first_books(rows: DataFrame, parts: int, entries: int) -> dict:
    """Of each length the parts of the vectors of the smallest ids."""
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at in _by_length(batch):
                kept[dim] = np.unique(np.r_[kept.get(dim, ids[:0]), ids[at]])[:entries]
        for dim, ids in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(ids)], ["dim", "id"])

    keyed = rows.withColumn("id", F.coalesce("vec_id", F.lit(LAST)))
    few = keyed.select("dim", "id").mapInArrow(smallest, "dim int, id long").distinct()
    lengths = [r.dim for r in few.select("dim").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    order = Window.partitionBy("dim").orderBy("id")
    chosen = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= entries).select("dim", "id").collect()
    wanted = keyed.filter(F.col("id").isin(sorted({r.id for r in chosen}))) if chosen else keyed.limit(0)
    # Of rows with one id the smallest vector.
    vectors = {(r.dim, r.id): r.v for r in wanted.groupBy("dim", "id").agg(F.min("v").alias("v")).collect()}
    books = {}
    for dim in lengths:
        start = [vectors[dim, i] for d, i in sorted(map(tuple, chosen)) if d == dim]
        x = np.array(start, np.int64).reshape(len(start), dim)
        books[dim] = [x[:, a:b] for a, b in zip(cuts(dim, parts), cuts(dim, parts)[1:])]
    return books


def _next_books(books: dict, sums: list) -> dict:
    out = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for r in sums:
        out[r.dim][r.part][r.entry, r.place] = r.total // r.n
    return out


def fingerprint(books: list[np.ndarray]) -> str:
    """A digest of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """``vec_id, label, dim, code, error`` of each usable row, and the final codebooks by length.

    ``code`` has a byte for each part. Vectors that are null or hold a null or non-finite
    component are left out. Codebooks start from the vectors of the smallest ids; a null id
    comes last, and of rows with one id the smallest vector counts. Ties go to the lower index;
    entries without vectors stay. Vectors of other lengths have codebooks of their own, for at
    most ``LENGTHS`` lengths; a length that does not divide has parts of nearly equal size, and
    empty parts have code 0. Repeated rows are coded each. Components whose squared distances
    could leave 64 bits raise an OverflowError. An empty table gives no rows and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    good = vectors.filter(usable("embedding"))
    check_sizes(good, "embedding", scale, 4)
    rows = store(good.select(F.col("vec_id").cast("long"), "label", F.size("embedding").alias("dim"),
                             floors("embedding", scale).alias("v")), "vectors")
    history = [_first_books(rows, parts, entries)]
    for _ in range(rounds):
        rows = store(_assigned(rows, history, parts), "codes")
        history.append(_next_books(history[-1], _sums(rows, parts)))
    known = rounds > 0
    schema = pa.schema([("code", pa.binary()), ("error", pa.int64())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for dim, at in _by_length(batch):
                code, _, _, errors[at] = _rounds(batch, dim, at, history, parts, known)
                for i, c in zip(at.tolist(), code):
                    codes[i] = c.tobytes()
            found = record_batch(schema, [codes, errors])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "dim")), *found.columns],
                ["vec_id", "label", "dim", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(last, f"vec_id long, label {kind}, dim int, code binary, error long"), history[-1]


def op12_norm_of_sum_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    coded, books = compress(vectors)
    rows = store(coded, "coded")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    name = F.lit(None).cast("string")
    for dim, book in books.items():
        name = F.when(F.col("dim") == dim, fingerprint(book)).otherwise(name)
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", name.alias("codebooks_sha256"))


def _sql() -> str:
    def assigned(books: str) -> str:
        return f"""SELECT vec_id, label, p, v, min(d * {ENTRIES} + k) % {ENTRIES} AS k, min(d) AS d FROM (
    SELECT x.*, c.k, list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN {books} AS c ON c.p = x.p) GROUP BY vec_id, label, p, v"""

    def refined(codes: str, books: str) -> str:
        return f"""SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM {books} AS b LEFT JOIN (
    SELECT p, k, list(floor(total / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, k, i, sum(v[i])::DOUBLE AS total, count(*)::DOUBLE AS n
      FROM {codes}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) WHERE i <= len(v) GROUP BY p, k, i)
    GROUP BY p, k) AS n ON n.p = b.p AND n.k = b.k"""

    out = f"""WITH w AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v
  FROM w, (SELECT unnest(range({PARTS})) AS p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS c
  FROM x WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT {ENTRIES})
)"""
    for r in range(ROUNDS + 1):
        out += f", a{r} AS MATERIALIZED (\n  {assigned(f'c{r}')}\n)"
        if r < ROUNDS:
            out += f", c{r + 1} AS MATERIALIZED (\n  {refined(f'a{r}', f'c{r}')}\n)"
    return out + f""", e AS (
  SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id, label
), s AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, s
"""


OP12_SQL = _sql()
