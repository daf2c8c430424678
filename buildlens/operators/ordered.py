"""Ordered computations over keys of any size.

A window over a key puts all rows of that key into one task. These functions cut the
time of a key into stretches (a day by default), and a stretch with more than
``crowd`` rows of one key into pieces of about ``crowd`` rows. They work inside each piece
and carry one summary row per piece to the pieces beside it. So rows spread over (key,
stretch, piece), and only the summaries meet on the key: one per day that has rows, and one
more per ``crowd`` rows. Keys must not be null.

Cut and carry come from a histogram: one aggregation of the input by (key, stretch), stored
once, with the number of rows and their summary. Only crowded stretches are counted again by
thousandths of a second, whose prefix sums say where pieces begin; rows of one thousandth
stay together, however many. So an input is read once for the histogram and once for the
rows, and once more where it has crowds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from buildlens.session import scratch

DAY = 86_400
CROWD = 1_000_000
_STRETCH, _PIECE, _SECOND, _TICK = "__stretch", "__piece", "__second", "__tick"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder: they are computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _named(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """The rows with their stretch, second, and thousandth of it."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    million = F.lit(1_000_000)
    return df.withColumns({
        _STRETCH: F.floor(micros / F.lit(seconds * 1_000_000)), _SECOND: F.floor(micros / million),
        _TICK: F.floor(F.pmod(micros, million) / F.lit(1000)).cast("int"),
    })


@dataclass(frozen=True)
class _Layout:
    """Where the pieces of an input begin (nothing if every stretch is one), and their summaries."""

    cuts: DataFrame | None
    parts: DataFrame | None

    def cut(self, df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
        """Name the stretch and the piece of each row; both grow with time."""
        rows = _named(df, ts, seconds)
        if self.cuts is None:
            return rows.withColumn(_PIECE, F.lit(0).cast("bigint")).drop(_SECOND, _TICK)
        piece = F.coalesce(F.col("__inside")[F.col(_TICK)], F.col("__base"), F.lit(0))
        return rows.join(self.cuts, [*keys, _STRETCH, _SECOND], "left") \
            .withColumn(_PIECE, piece.cast("bigint")).drop("__base", "__inside", _SECOND, _TICK)


def _layout(
    df: DataFrame, keys: list[str], ts: str, seconds: int, crowd: int,
    part: Column | None = None, merge: Callable[[str], Column] | None = None,
) -> _Layout:
    """The pieces of ``df``; ``part`` summarises rows, and ``merge`` such summaries."""
    aggregates = [F.count("*").alias("__n")] + ([] if part is None else [part.alias("__part")])
    named = _named(df, ts, seconds)
    whole = _stored(named.groupBy(*keys, _STRETCH).agg(*aggregates), "histogram")
    crowded = whole.filter(F.col("__n") > crowd).select(*keys, _STRETCH)
    alone = whole.withColumn(_PIECE, F.lit(0).cast("bigint"))
    if not crowded.head(1):
        return _Layout(None, alone)
    ticks = _stored(
        named.join(crowded, [*keys, _STRETCH], "left_semi")
        .groupBy(*keys, _STRETCH, _SECOND, _TICK).agg(*aggregates), "ticks")
    # Two prefix sums: of a stretch at most as many rows as it has seconds meet, of a second 1,000.
    by_second = Window.partitionBy(*keys, _STRETCH).orderBy(_SECOND)
    by_tick = Window.partitionBy(*keys, _STRETCH, _SECOND).orderBy(_TICK)
    base = ticks.groupBy(*keys, _STRETCH, _SECOND).agg(F.sum("__n").alias("__in")) \
        .withColumn("__ahead", F.coalesce(F.sum("__in").over(_before(by_second)), F.lit(0))).drop("__in")
    ahead = F.col("__ahead") + F.coalesce(F.sum("__n").over(_before(by_tick)), F.lit(0))
    pieces = _stored(
        ticks.join(base, [*keys, _STRETCH, _SECOND])
        .withColumn(_PIECE, F.floor(ahead / F.lit(crowd))).drop("__ahead"), "pieces")
    inside = F.map_from_entries(F.collect_list(F.struct(_TICK, _PIECE)))
    cuts = pieces.groupBy(*keys, _STRETCH, _SECOND).agg(
        F.min(_PIECE).alias("__base"), F.max(_PIECE).alias("__top"), inside.alias("__inside")
    ).withColumn("__inside", F.when(F.col("__top") > F.col("__base"), F.col("__inside"))).drop("__top")
    if part is None:
        return _Layout(_stored(cuts, "cuts"), None)
    parts = pieces.groupBy(*keys, _STRETCH, _PIECE).agg(merge("__part").alias("__part"))
    calm = alone.join(crowded, [*keys, _STRETCH], "left_anti").select(*parts.columns)
    return _Layout(_stored(cuts, "cuts"), _stored(parts.unionByName(calm), "parts"))


def _cut(df: DataFrame, keys: list[str], ts: str, seconds: int, crowd: int) -> DataFrame:
    """Name the stretch and the piece of each row; both grow with time."""
    return _layout(df, keys, ts, seconds, crowd).cut(df, keys, ts, seconds)


def _with_carry(
    rows: DataFrame, parts: DataFrame, keys: list[str], local: Column,
    over: Callable[[str, WindowSpec], Column],
) -> DataFrame:
    """``rows`` with ``local``, and what the pieces on one side amount to as ``__carry``.

    ``parts`` has the summary of each piece; ``over`` reads those on the wanted side.
    """
    across = Window.partitionBy(*keys).orderBy(_STRETCH, _PIECE)
    carry = parts.select(*keys, _STRETCH, _PIECE, over("__part", across).alias("__carry"))
    return rows.withColumn("__local", local).join(carry, [*keys, _STRETCH, _PIECE], "left")


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, _STRETCH, _PIECE).orderBy(*order)


def _up_to_here(keys: list[str], ts: str) -> WindowSpec:
    return _inside(keys, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(
    df: DataFrame, keys: list[str], ts: str, value: str, out: str,
    also: dict[str, Column] | None = None, seconds: int = DAY, crowd: int = CROWD,
) -> DataFrame:
    """One row per (keys, ts): the sum of ``value`` there, and up to there as ``out``.

    ``also`` names further aggregates of an instant. Rows of one instant add up before
    the shuffle; crowds and carries are taken from the rows as they come.
    """
    also = also or {}
    layout = _layout(df.select(*keys, ts, value), keys, ts, seconds, crowd, F.sum(value), F.sum)
    instants = df.groupBy(*keys, ts).agg(
        F.sum(value).alias(value), *[c.alias(n) for n, c in also.items()]
    )
    return _with_carry(
        layout.cut(instants, keys, ts, seconds), layout.parts, keys,
        local=F.sum(value).over(_up_to_here(keys, ts)),
        over=lambda c, w: F.coalesce(F.sum(c).over(_before(w)), F.lit(0)),
    ).select(*keys, ts, value, *also, (F.col("__local") + F.coalesce("__carry", F.lit(0))).alias(out))


def last_known(
    df: DataFrame, keys: list[str], ts: str, value: str, tie: str, out: str,
    seconds: int = DAY, crowd: int = CROWD,
) -> DataFrame:
    """One row per (keys, ts): the last non-null ``value`` up to there as ``out``.

    Among the values of one instant the one with the greatest ``tie`` counts. Rows of
    one instant shrink to one before the shuffle; crowds and carries are taken from
    the rows as they come.
    """
    there = F.col(value).isNotNull()
    place = F.struct(ts, tie)
    boxed = F.max_by(F.when(there, F.struct(place.alias("at"), F.col(value).alias("v"))), F.when(there, place))
    raw = df.select(*keys, ts, value, tie)
    layout = _layout(raw, keys, ts, seconds, crowd, boxed, lambda c: F.max_by(c, F.col(c)["at"]))
    instants = raw.groupBy(*keys, ts).agg(F.max_by(value, F.when(there, F.col(tie))).alias(value))
    return _with_carry(
        layout.cut(instants, keys, ts, seconds), layout.parts, keys,
        local=F.last(value, ignorenulls=True).over(_up_to_here(keys, ts)),
        over=lambda c, w: F.last(c, ignorenulls=True).over(_before(w))["v"],
    ).select(*keys, ts, F.coalesce("__local", "__carry").alias(out))


def changes(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], value: str,
    previous: str, until: str, seconds: int = DAY, crowd: int = CROWD,
) -> DataFrame:
    """Rows whose ``value`` differs from the row before, in (ts, tie) order.

    ``previous`` is the value before, ``until`` the time of the next change. Both
    steps share one cut; the changes are stored between them. (keys, ts, tie) must be unique.
    """
    place = F.struct(*[F.col(c) for c in [ts, *tie]])
    boxed = F.struct(F.col(value).alias("v"))  # tells a null value from no row
    last = F.max_by(F.struct(place.alias("at"), boxed.alias("box")), place)
    layout = _layout(df, keys, ts, seconds, crowd, last, lambda c: F.max_by(c, F.col(c)["at"]))
    seen = _with_carry(
        layout.cut(df, keys, ts, seconds), layout.parts, keys,
        local=F.lag(boxed).over(_inside(keys, ts, *tie)),
        over=lambda c, w: F.lag(c).over(w)["box"],
    )
    before = F.coalesce("__local", "__carry")["v"]
    changed = _stored(seen.withColumn(previous, before).drop("__local", "__carry").filter(
        ~F.col(value).eqNullSafe(F.col(previous))
    ), "changes")
    first = changed.groupBy(*keys, _STRETCH, _PIECE).agg(F.min(ts).alias("__part"))
    return _with_carry(
        changed, first, keys,
        local=F.lead(ts).over(_inside(keys, ts, *tie)),
        over=lambda c, w: F.lead(c).over(w),
    ).select(*df.columns, previous, F.coalesce("__local", "__carry").alias(until))
