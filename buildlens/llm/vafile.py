"""Exact top-k inner products with vector-approximation files.

Queries and vectors meet in cells of bounded size. A cell keeps a coarse approximation of
its vectors, a few bits for each component, and scans that first: the quantisation gives
each vector a largest and a smallest possible score. Exact vectors are read in the order of
the largest possible score, until the k-th exact score is above all that is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import table
from buildlens.llm.integers import check_sizes, floors, usable

SCALE, K, EVERY = 64, 20, 20
CELL_BITS = 6
# Vectors and queries of a cell, vectors scanned at a time, exact vectors read at a time.
CELL_VECTORS, CELL_QUERIES, SCAN, READ = 65_536, 16_384, 8_192, 64
QUERIES_AT_ONCE = 256
DDL = "query_id long, query long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, dim``: floor(scale * x) of every usable vector."""
    good = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    check_sizes(good, "embedding", scale, 2)
    return good.select(F.col("vec_id").cast("long"), floors("embedding", scale).alias("v"),
                       F.size("embedding").alias("dim"))


class Cell:
    """The approximation of some vectors, and the vectors themselves."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        self.ids, self.exact = ids, exact
        low, high = int(exact.min(initial=0)), int(exact.max(initial=0))
        self.shift = 0
        while (high >> self.shift) - (low >> self.shift) >= 1 << CELL_BITS:
            self.shift += 1
        self.base = low >> self.shift
        self.codes = ((exact >> self.shift) - self.base).astype(np.uint8)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
        """For each query the places and scores of its k best in this cell."""
        found = []
        spread = float((1 << self.shift) - 1)
        q = queries.astype(np.float64)
        above = np.where(q > 0, q, 0).sum(1) * spread
        below = np.where(q < 0, q, 0).sum(1) * spread
        # What rounding could hide in the bounds.
        slack = np.abs(q).sum(1) * float(np.abs(self.exact).max(initial=0) + spread) * 1e-13
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        for at in range(0, len(self.ids), SCAN):
            low = ((self.codes[at:at + SCAN].astype(np.int64) + self.base) << self.shift).astype(np.float64)
            bound = q @ low.T
            for i in range(len(q)):
                best[i] = self._settle(
                    bound[i], at, best[i], k, query_ids[i], queries[i], above[i] + slack[i], below[i] - slack[i])
        for i, (place, score) in enumerate(best):
            found.append((place, score))
        return found

    def _settle(self, bound, at, best, k, own, query, above, below):
        place, score = best
        other = self.ids[at:at + len(bound)] != own
        bound = np.where(other, bound, -np.inf)
        floor = score[-1] if len(score) >= k else -np.inf
        if len(bound) > k:
            floor = max(floor, np.partition(bound, -k)[-k] + below)
        near = np.flatnonzero((bound + above >= floor) & other)
        near = near[np.argsort(-bound[near], kind="stable")]
        for i in range(0, len(near), READ):
            part = near[i:i + READ]
            if len(score) >= k and bound[part[0]] + above < score[-1]:
                break
            place = np.append(place, part + at)
            score = np.append(score, self.exact[part + at] @ query)
            order = np.lexsort((self.ids[place], -score))[:k]
            place, score = place[order], score[order]
        return place, score


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.int64())
    return flat.to_numpy().reshape(len(column), dim)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE,
            cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each query row.

    Queries are the rows whose id is divisible by ``every``. Ties go to the smaller id. Rows
    with the query's id are its own and no candidates. Vectors that are null or hold a null or
    non-finite component, and rows without an id take no part; vectors of other lengths are
    not compared. Repeated rows stand as candidates each by themselves, and repeated query
    rows are asked once. Components whose scores could leave 64 bits raise an OverflowError.

    The grid of cells is the stated set of queries against all rows: vectors are copied to
    each group of queries and queries to each group of vectors, both of bounded size.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, scale)
    asked = whole.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    n, n_asked = whole.count(), asked.count()
    tasks = spark.sparkContext.defaultParallelism * 2
    groups = max(1, -(-n // cell_vectors), min(tasks, -(-n // 4096)))
    asked_groups = max(1, -(-n_asked // cell_queries))
    part = F.xxhash64("vec_id", "v")
    left = whole.select(
        "vec_id", "v", "dim", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(groups)).alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(asked_groups - 1))).alias("a"))
    right = asked.select(
        "vec_id", "v", "dim", part.alias("query"),
        F.pmod(part, F.lit(asked_groups)).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def search(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        dim = key[2].as_py()
        if vectors.num_rows and queries.num_rows:
            cell = Cell(vectors["vec_id"].to_numpy(), _matrix(vectors["v"], dim))
            ids, names = queries["vec_id"].to_numpy(), queries["query"].to_numpy()
            all_queries = _matrix(queries["v"], dim)
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                for q, name, (place, score) in zip(
                        ids[part], names[part], cell.search(ids[part], all_queries[part], k)):
                    out[0].append(np.full(len(place), q))
                    out[1].append(np.full(len(place), name))
                    out[2].append(cell.ids[place])
                    out[3].append(score)
        columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        return pa.table(columns, ["query_id", "query", "vec_id", "score"])

    found = left.groupBy("g", "a", "dim").cogroup(right.groupBy("g", "a", "dim")) \
        .applyInArrow(search, DDL)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op3_va_file(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}
"""
