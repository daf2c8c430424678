"""Compare a Spark result with the answer of DuckDB, cell by cell."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from buildlens.plans.registry import TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            path = path / "*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    return v


_KIND = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE", "float": "FLOAT",
}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs in columns, types, rows; nothing if all agree."""
    out = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if _KIND.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} != {types[name]}")
    order = sorted(names)
    theirs = Counter(tuple(_cell(r[names.index(c)]) for c in order) for r in rows)
    ours = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
    if sum(ours.values()) != sum(theirs.values()):
        out.append(f"rows {sum(ours.values())} != {sum(theirs.values())}")
    if not rows:
        out.append("no rows")
    for label, rest in (("only here", ours - theirs), ("only there", theirs - ours)):
        if rest:
            out.append(f"{label}: {sum(rest.values())}, e.g. {order} {next(iter(rest))}")
    return out


def main() -> None:
    """``python -m tests.compare FOLDER [name-prefix ...]``"""
    import sys
    import time
    import traceback

    import __spark_entry__ as entry
    from buildlens.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            found = differences(df, con, sql[name]) if name in sql else \
                [] if df.count() else ["no rows"]
        except Exception:
            found = [traceback.format_exc(limit=3)[-1500:]]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n   "
              if found else " ")
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
