"""Build matrices and other one-to-many rows.

Each matrix is an array made from the row itself and exploded, so nothing is joined
or shuffled and the conditions stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.site import DEFAULT_SITE, Site

_BUILD = "array<struct<product:string,arch:string,failpoint:boolean>>"
_STAGE = "array<struct<stage:string,product:string,kind:string,debug:boolean>>"


def _builds(products: list[str], arch: str, failpoint: bool) -> Column:
    return F.array(*[
        F.struct(F.lit(p).alias("product"), F.lit(arch).alias("arch"),
                 F.lit(failpoint).alias("failpoint"))
        for p in products
    ])


def _only(condition: Column, entries: Column, kind: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), entries).otherwise(F.array().cast(kind))


def prerelease_matrix(df: DataFrame, branch: str = "branch", tag: str = "tag") -> DataFrame:
    b, t = F.col(branch), F.col(tag)
    newer, newer_from = fixed.PRERELEASE_NEWER
    arm = F.concat(
        _builds(fixed.PRERELEASE_PRODUCTS, "arm64", False),
        _builds(fixed.PRERELEASE_FAILPOINT, "arm64", True),
    )
    entries = F.concat(
        _builds(fixed.PRERELEASE_PRODUCTS, "amd64", False),
        _only(t >= newer_from, _builds([newer], "amd64", False), _BUILD),
        _builds(fixed.PRERELEASE_FAILPOINT, "amd64", True),
        _only(b == fixed.PRERELEASE_ARM_BRANCH, arm, _BUILD),
    )
    return df.withColumn("entry", F.explode(entries)).select(*df.columns, "entry.*")


def _stages(products: list[str], suffix: str, kind: str, debug: bool) -> Column:
    return F.array(*[
        F.struct(F.lit(f"{p}{suffix}").alias("stage"), F.lit(p).alias("product"),
                 F.lit(kind).alias("kind"), F.lit(debug and p != fixed.NIGHTLY_WITHOUT_DEBUG).alias("debug"))
        for p in products
    ])


def nightly_matrix(df: DataFrame, branch: str = "branch", multiarch: bool = True) -> DataFrame:
    """``multiarch`` names the stages; the text comparison of branches is kept as it is."""
    b = F.col(branch)
    suffix = "-multi-arch" if multiarch else ""
    master = b == fixed.NEWEST_BRANCH
    newer = (b >= fixed.NIGHTLY_NEWER_BRANCH) | master
    entries = F.concat(
        _only(master, _stages([fixed.NIGHTLY_MASTER_PRODUCT], "", "monitoring", False), _STAGE),
        _stages([fixed.NIGHTLY_SINGLE_ARCH], "-build", "normal", False),
        _stages(fixed.NIGHTLY_PRODUCTS, suffix, "normal", True),
        _only(newer, _stages(fixed.NIGHTLY_NEWER_PRODUCTS, suffix, "normal", True), _STAGE),
        _stages(fixed.NIGHTLY_FAILPOINT, "-failpoint", "failpoint", False),
    )
    return df.withColumn("entry", F.explode(entries)).select(*df.columns, "entry.*")


def tiup_matrix(df: DataFrame) -> DataFrame:
    products = F.explode(F.array(*map(F.lit, fixed.TIUP_PRODUCTS)))
    platforms = F.explode(F.array(*map(F.lit, fixed.TIUP_PLATFORMS)))
    return df.withColumn("product", products).withColumn("platform", platforms)


def arm_binary_matrix(df: DataFrame) -> DataFrame:
    return df.withColumn("product", F.explode(F.array(*map(F.lit, fixed.ARM_BINARY_PRODUCTS)))) \
        .withColumn("platform", F.lit("linux-arm64"))


def expand_arch(df: DataFrame, col: str = "arch") -> DataFrame:
    """``both`` gives two rows; an unknown arch gives one row with ``error`` set."""
    c = F.col(col)
    known = F.coalesce(c.isin("amd64", "arm64"), F.lit(False))
    wanted = F.when(c == "both", F.array(F.lit("amd64"), F.lit("arm64"))).otherwise(F.array(c))
    error = F.when(~known & ~F.coalesce(c == "both", F.lit(False)),
                   F.concat(F.lit("unknown arch "), F.coalesce(c, F.lit("null"))))
    return df.withColumn("error", error).withColumn(col, F.explode(wanted)) \
        .withColumn(col, F.when(F.col("error").isNull(), F.col(col)))


def explode_csv(df: DataFrame, col: str, out: str) -> DataFrame:
    """One row per piece of a comma list; empty pieces at the end do not count."""
    return df.withColumn(out, F.explode(F.split(F.regexp_replace(col, ",+$", ""), ",")))


def route_images(df: DataFrame, col: str = "images", site: Site = DEFAULT_SITE) -> DataFrame:
    """Push and sync steps for a comma list of images.

    Public images go to a staging name and are synced from there; images of the two
    own registries are pushed as they are; all others are dropped.
    """
    item = F.col("image")
    staged = F.concat(F.lit(f"{site.registry}/image-sync/"), item)

    def step(action: str, source: Column, target: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), source.alias("source"), target.alias("target"))

    none = F.lit(None).cast("string")
    steps = F.when(
        item.startswith(f"{site.org}/"),
        F.array(step("push", none, staged), step("sync", staged, item)),
    ).when(
        item.startswith(f"{site.registry}/") | item.startswith(f"{site.mirror_registry}/"),
        F.array(step("push", none, item)),
    )
    return (
        explode_csv(df, col, "image").withColumn("step", F.explode(steps))
        .select(*df.columns, "image", "step.*")
    )


def expected_runs(schedules: DataFrame, first: Column, last: Column) -> DataFrame:
    """One expected run per schedule and day."""
    return schedules.withColumn(
        "day", F.explode(F.sequence(first, last, F.expr("interval 1 day")))
    )


def missed_runs(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")
