"""Defaults and parameters of one task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed


def default_timeout(c: Column) -> Column:
    return F.when(c > 1, c).otherwise(F.lit(fixed.DEFAULT_TIMEOUT_MINUTES))


def default_retry(c: Column) -> Column:
    return F.when(c <= fixed.MAX_RETRY, c).otherwise(F.lit(0))


def _sized(part: Column) -> Column:
    """A resource block with both values present."""
    return F.coalesce(
        (F.length(part["cpu"]) >= 1) & (F.length(part["memory"]) >= 1), F.lit(False)
    )


def _block(memory: Column, cpu: Column) -> Column:
    return F.struct(memory.alias("memory"), cpu.alias("cpu"))


def default_resources(c: Column) -> Column:
    """struct(limits, requests, requests_dropped).

    Without usable requests both blocks take the default. With usable requests but
    no usable limits, the limits take the requests and the requests come back empty;
    ``requests_dropped`` marks those rows.
    """
    default = _block(F.lit(fixed.DEFAULT_MEMORY), F.lit(fixed.DEFAULT_CPU))
    empty = _block(F.lit(None).cast("string"), F.lit(None).cast("string"))
    requests = _block(c["requests"]["memory"], c["requests"]["cpu"])
    limits = _block(c["limits"]["memory"], c["limits"]["cpu"])
    no_requests, no_limits = ~_sized(c["requests"]), ~_sized(c["limits"])
    return F.struct(
        F.when(no_requests, default).when(no_limits, requests).otherwise(limits).alias("limits"),
        F.when(no_requests, default).when(no_limits, empty).otherwise(requests).alias("requests"),
        (~no_requests & no_limits).alias("requests_dropped"),
    )


def substitute_vars(script: Column, *key_arrays: Column) -> Column:
    """Replace ``${KEY}`` by ``$KEY`` for the given keys, in order; others stay."""
    out = F.coalesce(script, F.lit(""))
    for keys in key_arrays:
        keys = F.coalesce(keys, F.array().cast("array<string>"))
        out = F.aggregate(
            keys, out,
            lambda acc, key: F.replace(
                acc, F.concat(F.lit("${"), key, F.lit("}")), F.concat(F.lit("$"), key)
            ),
        )
    return out


def env_list(branch: Column, variables: Column) -> Column:
    """``TARGET_BRANCH=<branch>`` and one ``K=V`` per variable."""
    pairs = F.transform(variables, lambda v: F.concat(v["key"], F.lit("="), v["value"]))
    head = F.array(F.concat(F.lit("TARGET_BRANCH="), branch))
    return F.concat(head, F.coalesce(pairs, F.array().cast("array<string>")))


def encode_secret_vars(c: Column) -> Column:
    """array<struct<secretID, key>> to ``id:key,id:key``."""
    return F.array_join(
        F.transform(c, lambda s: F.concat(s["secretID"], F.lit(":"), s["key"])), ","
    )


def decode_secret_vars(c: Column) -> Column:
    """The inverse; pieces without exactly two parts are left out."""

    def parts(piece: Column) -> Column:
        return F.split(F.regexp_replace(piece, ":+$", ""), ":")

    pieces = F.filter(F.split(c, ","), lambda p: F.size(parts(p)) == 2)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.get(parts(p), F.lit(0)).alias("secretID"), F.get(parts(p), F.lit(1)).alias("key")
        ),
    )
