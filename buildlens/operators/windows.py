"""History per job, task and id, and first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.operators import ordered


def last_builds(
    df: DataFrame, job: list[str], order: list[Column], n: int = fixed.HISTORY_BUILDS
) -> DataFrame:
    """The ``n`` latest builds per job, with their rank as ``build_rank``.

    A rank filter of this form is pushed below the shuffle by the planner: each task
    keeps at most ``n`` builds per job, so a job with most of the rows stays small.
    """
    latest = Window.partitionBy(*job).orderBy(*order)
    return df.withColumn("build_rank", F.row_number().over(latest)).filter(
        F.col("build_rank") <= n
    )


def final_attempt(
    df: DataFrame, keys: list[str], tries: int, attempt: str = "attempt",
    result: str = "result",
) -> DataFrame:
    """The attempt that decides: the first success within the tries, else the last one.

    ``tries`` counts all attempts; less than one means one. Only two candidates per
    key leave a task, so retries are not shuffled.
    """
    limit = max(tries, 1)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    success = F.col(result).eqNullSafe(F.lit("SUCCESS"))
    return (
        df.filter(F.col(attempt) <= limit)
        .groupBy(*keys)
        .agg(F.min_by(row, F.when(success, F.col(attempt))).alias("__first"),
             F.max_by(row, F.col(attempt)).alias("__last"))
        .select(*keys, F.coalesce("__first", "__last").alias("__row"))
        .select(*keys, "__row.*")
    )


def latest_status(df: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """The last update per id, as an aggregation: one row per id leaves each task."""
    row = F.struct(*order, *[c for c in df.columns if c not in {*ids, *order}])
    return df.groupBy(*ids).agg(F.max_by(row, F.struct(*order)).alias("__row")) \
        .select(*ids, "__row.*")


def status_transitions(
    df: DataFrame, ids: list[str], ts: str = "ts", tie: list[str] = ["event_id"],
    status: str = "status", seconds: int = ordered.DAY, crowd: int = ordered.CROWD,
) -> DataFrame:
    """State changes with the state before and the time until the next change."""
    changes = ordered.changes(
        df, ids, ts, tie, status, "previous_status", "__next", seconds, crowd
    )
    micros = F.unix_micros(F.col("__next").cast("timestamp")) - \
        F.unix_micros(F.col(ts).cast("timestamp"))
    return changes.withColumn("in_state_us", micros).drop("__next")


def parallel_load(
    df: DataFrame, keys: list[str], start: str, end: str, seconds: int = ordered.DAY,
    crowd: int = ordered.CROWD,
) -> DataFrame:
    """Tasks running at each start: started at or before it and not ended by then.

    A start counts one up and an end one down; the running sum of both is the load.
    """
    at, change = F.col("instant"), F.col("change")
    points = df.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col(start).alias("instant"), F.lit(1).alias("change")),
            F.struct(F.col(end).alias("instant"), F.lit(-1).alias("change")),
        )).alias("p"),
    ).select(*keys, "p.*")
    load = ordered.running_sum(
        points, keys, "instant", "change", "running", {"starts": F.count_if(change > 0)},
        seconds, crowd,
    )
    return load.filter(F.col("starts") > 0).select(*keys, at, "starts", "running")


def first_plan(
    answers: DataFrame, query: list[str], order: list[str]
) -> DataFrame:
    """First answer per query; a query without answers gives no row."""
    row = F.struct(*order, *[c for c in answers.columns if c not in {*query, *order}])
    return answers.groupBy(*query).agg(F.min_by(row, F.struct(*order)).alias("__row")) \
        .select(*query, "__row.*")


def _parts(text: Column, n: int) -> Column:
    """The ``n`` characters from each place on; fewer at the end."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def search_first_plan(
    queries: DataFrame, plans: DataFrame, query: str = "query", name: str = "name", order: list[str] = ["plan_id"],
) -> DataFrame:
    """First plan whose name contains the query, for each row of ``queries``; no plan, no row.

    The answer to a name search for very many queries and plans. Each distinct query has a form:
    a stretch of three of its characters, the place of that stretch in it, and its length. Of the
    stretches it holds, that one counts whose form has the fewest names for each query of the
    form. A name gives out what it holds around its stretches in the forms that are asked, and
    this meets the queries by equality, so neither a query nor a name is compared with others.
    Queries of one or two characters begin the stretches of the names. Equal names are one, with
    their first plan. A null or empty query finds nothing.

    The joins are sort-merge joins by hint: a name has as many stretches as characters, which the
    planner doesn't count when it estimates what is small enough to be broadcast.
    """
    rest = [c for c in plans.columns if c not in {*order, name}]
    named = plans.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(
        F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__plan"))
    asked = queries.select(F.col(query).alias("__query")).filter(F.length(query) > 0).distinct()
    stretches = F.posexplode(_parts(F.col("__name"), 3)).alias("__pos", "__gram")
    count = named.select("__name", stretches).groupBy("__gram").agg(F.count("*").alias("__n")).hint("merge")
    whole = F.length("__gram") == 3
    long = asked.filter(F.length("__query") > 2).select(
        "__query", F.length("__query").alias("__len"), F.posexplode(_parts(F.col("__query"), 3)).alias("__at", "__gram")).filter(whole)
    form = ["__gram", "__at", "__len"]
    cost = F.coalesce("__n", F.lit(0)) / F.col("__m")
    costs = long.groupBy(*form).agg(F.count("*").alias("__m")).join(count, "__gram", "left").select(*form, cost.alias("__cost"))
    chosen = long.join(costs.hint("merge"), form).groupBy("__query").agg(
        F.min(F.struct("__cost", *form)).alias("__form")).select(*[f"__form.{c}" for c in form])
    begins = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.substring(F.col("__gram"), F.lit(1), n)))
    short = count.select("__gram", F.explode(begins).alias("__query")).join(asked.hint("merge"), "__query", "left_semi") \
        .select("__gram", F.lit(0).alias("__at"), F.length("__query").alias("__len"))
    forms = chosen.unionByName(short).distinct()
    first = F.col("__pos") - F.col("__at") + 1
    key = F.struct(*[F.col(f"__plan.{c}").alias(f"o{i}") for i, c in enumerate(order)])
    # The partial aggregation leaves one row of a text to a task, however many names hold it.
    found = named.select("__name", key.alias("__order"), stretches).join(forms.hint("merge"), "__gram") \
        .filter((first > 0) & (first + F.col("__len") <= F.length("__name") + 1)) \
        .groupBy(F.substring("__name", first, F.col("__len")).alias("__query")) \
        .agg(F.min(F.struct("__order", F.col("__name").alias("name"))).alias("__key"))
    answers = queries.join(found.hint("merge"), F.col(query) == F.col("__query"))
    if rest:
        answers = answers.join(named.hint("merge"), F.col("__key.name") == F.col("__name"))
        kept = ["__plan.*"]
    else:
        kept = [F.col(f"__key.__order.o{i}").alias(c) for i, c in enumerate(order)]
    return answers.select(*queries.columns, F.col("__key.name").alias(name), *kept)


def distinct_sorted_tags(df: DataFrame, col: str = "tag") -> DataFrame:
    """Distinct values in byte order."""
    return df.select(col).distinct().orderBy(col)
