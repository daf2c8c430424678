"""Unions and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens import fixed


def union_images(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def with_alias_images(
    df: DataFrame, product: str = "product", alias: tuple[str, str] = fixed.IMAGE_ALIAS
) -> DataFrame:
    """Each image, and for one product the same image under its other name."""
    name, other = alias
    both = F.when(F.col(product) == name, F.array(F.lit(name), F.lit(other))) \
        .otherwise(F.array(F.col(product)))
    return df.withColumn("image_product", F.explode(both))


def open_executions(all_ids: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Ids without a final answer."""
    return all_ids.join(finished.select(*keys).distinct(), keys, "left_anti")


def union_runs(daily: DataFrame, merge: DataFrame, verify: DataFrame) -> DataFrame:
    """One table from three result layouts; fields a layout lacks are null."""
    return daily.unionByName(merge, allowMissingColumns=True) \
        .unionByName(verify, allowMissingColumns=True)
