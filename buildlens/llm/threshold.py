"""Hard negatives by the threshold algorithm.

Candidates are dealt into cells of bounded size. A cell keeps its rows sorted by every
dimension. An anchor reads those lists from the end that its sign asks for, all in step, and
scores each row it meets for the first time by its whole vector. The scores at the present
depth of the lists bound what was not met yet; the search ends once that bound is strictly
below the last wanted score of each window, or below the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import store, table
from buildlens.llm.integers import check_sizes, floors, matrix, usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
# A negative's score as a percentage of the positive's.
LOW, HIGH = 50, 95
# Rows of a cell, anchors of a cell, rows of each list read in a step.
CELL, ANCHORS, STEP = 16_384, 4_096, 64
LEAST, MOST = -(1 << 62), 1 << 62


class SortedLists:
    """Rows sorted by each dimension."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        self.ids, self.exact = ids, exact
        self.up = np.argsort(exact, axis=0, kind="stable")

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple]:
        """``rows, scores`` of the ``k`` best allowed rows, ties to smaller ids, in each window.

        A window is the smallest and the largest score it admits.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        # An anchor of noughts scores all rows alike: any list will do.
        if not len(up) + len(down):
            up = np.arange(min(1, self.up.shape[1]))
        unmet = allowed.copy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = list(range(len(windows)))
        depth = 0
        # With all rows met there is nothing left to bound.
        while open_ and unmet.any():
            stop = min(depth + STEP, n)
            here = np.zeros(n, bool)
            if len(up) + len(down):
                here[self.up[depth:stop, up]] = True
                here[self.up[n - stop:n - depth, down]] = True
            else:
                here[depth:stop] = True
            rows = np.flatnonzero(here & unmet)
            unmet[rows] = False
            scores = self.exact[rows] @ anchor
            depth = stop
            bound = int(self.exact[self.up[depth - 1, up], up] @ anchor[up]
                        + self.exact[self.up[n - depth, down], down] @ anchor[down])
            for w in list(open_):
                low, high = windows[w]
                here = (scores >= low) & (scores <= high)
                r, s = np.append(found[w][0], rows[here]), np.append(found[w][1], scores[here])
                order = np.lexsort((self.ids[r], -s))[:k]
                found[w] = r[order], s[order]
                if bound < low or len(order) == k and bound < s[order[-1]]:
                    open_.remove(w)
        return found


class Cell:
    """Some candidates, together and by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, exact: np.ndarray):
        self.ids, self.labels, self.exact = ids, labels, exact
        self.all, self.of = None, {}

    def positives(self, own: int, label: int, anchor: np.ndarray, k: int) -> tuple:
        """``ids, scores`` of the best other rows of the same label."""
        if label not in self.of:
            here = self.labels == label
            self.of[label] = SortedLists(self.ids[here], self.exact[here])
        lists = self.of[label]
        (rows, scores), = lists.best(anchor, lists.ids != own, [(LEAST, MOST)], k)
        return lists.ids[rows], scores

    def negatives(self, own: int, label: int, anchor: np.ndarray, windows: list[tuple], k: int) -> list[tuple]:
        """``ids, scores`` of the best rows of other labels in each window."""
        if self.all is None:
            self.all = SortedLists(self.ids, self.exact)
        allowed = (self.labels != label) & (self.ids != own)
        return [(self.ids[rows], scores) for rows, scores in self.all.best(anchor, allowed, windows, k)]


def _grid(rows: DataFrame, anchors: DataFrame, cell: int, asked: int, search, ddl: str) -> DataFrame:
    """``search(cell, anchors)`` for each cell of rows and each group of anchors of its length."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism * 2
    n, n_anchors = rows.count(), anchors.count()
    groups = max(1, -(-n // cell), min(tasks, -(-n // 2048)))
    asked_groups = max(1, -(-n_anchors // asked))
    left = rows.select("*", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(groups)).alias("g"),
                       F.explode(F.sequence(F.lit(0), F.lit(asked_groups - 1))).alias("a"))
    right = anchors.select("*", F.pmod(F.col("anchor"), F.lit(asked_groups)).cast("int").alias("a"),
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in names]
        if rows.num_rows and anchors.num_rows:
            dim = key[2].as_py()
            here = Cell(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], dim))
            for i, anchor in enumerate(matrix(anchors["v"], dim)):
                for found in search(here, anchors, i, anchor):
                    n = len(found[-1])
                    for column, value in zip(out, found):
                        column.append(np.broadcast_to(np.asarray(value, np.int64), n))
        return pa.table([pa.array(np.concatenate(c)) for c in out], names)

    return left.groupBy("g", "a", "dim").cogroup(right.groupBy("g", "a", "dim")).applyInArrow(run, ddl)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES, cell: int = CELL,
              asked: int = ANCHORS) -> DataFrame:
    """``anchor, anchor_id, positive_id, positive_score``: the best other rows of the same label."""
    def search(cell: Cell, anchors: pa.Table, i: int, vector: np.ndarray):
        own, name, label = (anchors[c][i].as_py() for c in ("vec_id", "anchor", "label"))
        yield name, own, *cell.positives(own, label, vector, k)

    found = _grid(rows, anchors, cell, asked, search,
                  "anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def hard_negatives(vectors: DataFrame, scale: int = SCALE, every: int = EVERY, n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cell: int = CELL,
                   asked: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Scores are inner products of whole
    numbers, floor(``scale`` * x); the higher comes first, of equal ones the smaller id. An
    anchor's positives are its ``n_positives`` first other rows of the same label; for each of
    them come the ``n_negatives`` first rows of other labels whose score is ``low`` to ``high``
    per cent of the positive's. A positive without such rows gives none.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no
    part; vectors of other lengths are not compared. Rows with the anchor's id are its own.
    Repeated rows are candidates each by themselves, and repeated anchors are asked once.
    Components whose scores could leave 64 bits raise an OverflowError.

    The grid of cells is the stated set of anchors against all rows, both in groups of bounded
    size; there are no more rows between than the wanted ones of each cell.
    """
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    check_sizes(good, "embedding", scale, 100)
    rows = store(good.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.size("embedding").alias("dim"),
                             floors("embedding", scale).alias("v")), "vectors")
    anchors = store(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
                    .withColumn("anchor", F.xxhash64("vec_id", "label", "v")), "anchors")
    near = store(positives(rows, anchors, n_positives, cell, asked), "positives")
    scores = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))

    def search(cell: Cell, anchors: pa.Table, i: int, vector: np.ndarray):
        own, name, label, scores = (anchors[c][i].as_py() for c in ("vec_id", "anchor", "label", "scores"))
        windows = [(-(-low * s // 100), high * s // 100) for s in scores]
        windows, scores = zip(*((w, s) for w, s in zip(windows, scores) if w[0] <= w[1])) if any(
            w[0] <= w[1] for w in windows) else ((), ())
        for s, (ids, found) in zip(scores, cell.negatives(own, label, vector, list(windows), n_negatives)):
            yield name, s, ids, found

    found = _grid(rows, store(anchors.join(scores, "anchor"), "asked"), cell, asked, search,
                  "anchor long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return near.join(first, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mislabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows, with the next label where the id is divisible by ``every``."""
    return vectors.withColumn("label", F.when(
        F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def op13_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(mislabelled(table(spark, folder, "embeddings")))


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
