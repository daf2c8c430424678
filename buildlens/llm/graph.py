"""Connected components of links between 64-bit values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every value in a link ``u, v``; the root is the smallest value reached.

    Alternates two steps that hang neighbours onto the smallest one, until nothing changes;
    each round is stored. A value with very many neighbours is one row of the aggregated
    side of a join, and its neighbours stay spread. Links to oneself and nulls are left out.
    """
    pairs = store(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") > F.col("v")).distinct(), "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") > F.col("m")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = store(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark, before = _mark(pairs), mark
        if mark == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select("v", "v").distinct())


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.bit_xor(F.xxhash64("v", "u"))).head())
