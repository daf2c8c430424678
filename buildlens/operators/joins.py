"""Joins.

The looked-up side is always reduced to one row per key before it is joined, with
map-side aggregation. A hot key then sits on the left side only, where adaptive
execution can split it (inner, left, semi and anti joins all allow that), and the
planner broadcasts the reduced side only when its measured size permits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.functions.versions import is_prerelease
from buildlens.operators import ordered


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def one_per_key(df: DataFrame, keys: list[str], value: str | Column, order: Column, out: str) -> DataFrame:
    """The value with the greatest order per key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(out))


def assign_task_ids(
    tasks: DataFrame, created: DataFrame, keys: list[str] = ["run_id", "taskName"],
    position: str = "position",
) -> DataFrame:
    """Ids given by the service, joined back by name; of several the last one counts."""
    ids = one_per_key(created, keys, "id", F.col(position), "__id")
    return tasks.drop("id").join(ids, keys, "left").withColumnRenamed("__id", "id")


def _stored(requests: DataFrame, artifacts: DataFrame, keys: list[str], force: str) -> tuple:
    have = artifacts.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    match = _all([F.col(k) == F.col(f"__{k}") for k in keys])
    return have, match & ~F.coalesce(F.col(force), F.lit(False))


def pending_builds(
    requests: DataFrame, artifacts: DataFrame, keys: list[str], force: str = "force"
) -> DataFrame:
    """Requests to build: no stored result, or forced. A forced row never matches."""
    have, match = _stored(requests, artifacts, keys, force)
    return requests.join(have, match, "left_anti")


def existing_builds(
    requests: DataFrame, artifacts: DataFrame, keys: list[str], force: str = "force"
) -> DataFrame:
    """Requests that are skipped; the complement of :func:`pending_builds`."""
    have, match = _stored(requests, artifacts, keys, force)
    return requests.join(have, match, "left_semi")


def head_ref(repo: Column, ref: Column) -> Column:
    """The ref to ask for; one repository calls its master branch main."""
    name, asked, real = fixed.HEAD_REF_EXCEPTION
    return F.when((repo == name) & (ref == asked), real).otherwise(ref)


def resolve_commit(
    requests: DataFrame, heads: DataFrame, order: Column, repo: str = "repo", ref: str = "ref",
    out: str = "commit",
) -> DataFrame:
    """Head commit of (repo, branch or tag); null where the ref is unknown."""
    latest = heads.groupBy(F.col("repo").alias("__repo"), F.col("ref").alias("__ref")).agg(
        F.max_by("sha", order).alias(out)
    )
    wanted = head_ref(F.col(repo), F.col(ref))
    return requests.join(
        latest, (F.col(repo) == F.col("__repo")) & (wanted == F.col("__ref")), "left"
    ).drop("__repo", "__ref")


def resolve_commit_asof(
    requests: DataFrame, commits: DataFrame, keys: list[str], ts: str, sha: str = "sha",
    tie: str | None = None, out: str = "commit", seconds: int = ordered.DAY,
    crowd: int = ordered.CROWD,
) -> DataFrame:
    """The head at request time: the last commit with a time at or before it.

    Commits and requests form one line of instants, one row each, so equal instants
    never pile up; the answers are then joined back to the requests on the instant.
    """
    points = commits.select(
        *keys, ts, F.col(sha).alias("__sha"), F.col(tie or sha).alias("__tie")
    )
    line = points.unionByName(requests.select(*keys, ts), allowMissingColumns=True)
    heads = ordered.last_known(line, keys, ts, "__sha", "__tie", out, seconds, crowd)
    return requests.join(heads, [*keys, ts], "left")


def effective_repo(product: Column, ref: Column, flow: str) -> Column:
    """The repository a product is built from, at this branch or tag.

    ``nightly`` and ``single_image`` go by branch, where master counts as newest;
    ``pre_release`` goes by tag. The moves are a handful of fixed rows, so the range
    join is a chain of conditions.
    """
    moves = {
        "nightly": fixed.NIGHTLY_REPO_MOVES,
        "pre_release": fixed.REPO_MOVES,
        "single_image": fixed.REPO_MOVES[:1],
    }[flow]
    out = product
    if flow == "nightly":
        part, whole = fixed.PACKED_WITH
        out = F.when(product == part, whole).otherwise(out)
    for name, first_branch, first_tag, repo in moves:
        moved = product == name
        if flow == "pre_release" and first_tag:
            moved = moved & (ref >= first_tag)
        elif first_branch:
            released = ref.startswith(fixed.RELEASE_PREFIX) & (ref >= first_branch)
            moved = moved & (released | (ref == fixed.NEWEST_BRANCH))
        out = F.when(F.coalesce(moved, F.lit(False)), repo).otherwise(out)
    return out


def moved_repo(
    requests: DataFrame, moves: DataFrame, product: str = "product", ref: str = "ref", out: str = "repo",
) -> DataFrame:
    """:func:`effective_repo` with a table of moves of any size.

    ``moves`` is (product, from_ref, to_ref, repo): the product is built from ``repo`` at refs
    from ``from_ref`` up to, but not at, ``to_ref``; null is no limit. Of the moves of a product
    the last one that begins at or before the ref decides, of equal beginnings the greatest
    repository; where it has ended, and without a move, the product is its own repository. Refs
    compare as text; a null ref is not moved.

    The boundaries and the distinct refs of a product form one line, along which the last
    boundary is carried, so no ref is compared with a move.
    """
    begin = F.struct(F.col("to_ref").alias("to"), F.col("repo").alias("repo"))
    boundaries = moves.filter(F.col("product").isNotNull() & F.col("repo").isNotNull()).select(
        F.col("product").alias("__product"), F.coalesce("from_ref", F.lit("")).alias("__ref"), "repo", "to_ref",
    ).groupBy("__product", "__ref").agg(F.max_by(begin, F.struct("repo", F.coalesce("to_ref", F.lit("")))).alias("__move"))
    asked = requests.select(F.col(product).alias("__product"), F.col(ref).alias("__ref")).dropna().distinct()
    line = boundaries.withColumn("__asked", F.lit(0)).unionByName(
        asked.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("__product").orderBy("__ref", "__asked") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = line.withColumn("__last", F.last("__move", ignorenulls=True).over(so_far)).filter("__asked = 1")
    open_ = F.col("__last.to").isNull() | (F.col("__ref") < F.col("__last.to"))
    found = last.filter(F.col("__last").isNotNull() & open_).select(
        "__product", "__ref", F.col("__last.repo").alias("__repo"))
    same = (F.col(product) == F.col("__product")) & (F.col(ref) == F.col("__ref"))
    return requests.join(found, same, "left").withColumn("__repo", F.coalesce("__repo", product)) \
        .drop("__product", "__ref", *([out] if out in requests.columns else [])).withColumnRenamed("__repo", out)


def expected_binaries(images: DataFrame, product: str = "product", tag: str = "tag") -> DataFrame:
    """One row per binary the image must hold; products not listed give none."""
    p, t = F.col(product), F.col(tag)
    listed = F.lit(None).cast("array<string>")
    for name, binaries in fixed.PRODUCT_BINARIES.items():
        listed = F.when(p == name, F.array(*map(F.lit, binaries))).otherwise(listed)
    bare = F.replace(t, F.lit("v"), F.lit(""))
    shrunk, dropped, dropped_from = fixed.DROPPED_BINARY
    later, listed_from = fixed.BINARIES_FROM
    listed = (
        F.when((p == shrunk) & (bare >= dropped_from), F.array_remove(listed, dropped))
        .when((p == later) & (t < listed_from), F.lit(None))
        .otherwise(listed)
    )
    return images.withColumn("binary", F.explode(listed))


def attest(
    expected: DataFrame, actual: DataFrame, keys: list[str],
    commit: str = "commit", tag: str = "tag", every_tag: bool = False,
) -> DataFrame:
    """Every expected and every actual binary of a nightly or alpha tag with a verdict.

    Binaries of other tags are not attested, unless ``every_tag`` is set.

    pass: commit and tag agree; fail: they differ; missing: nothing was built;
    unexpected: nobody asked for it. The full outer join is written as a left and an
    anti join, as only those can split a hot key.
    """
    if not every_tag:
        expected, actual = (df.filter(is_prerelease(F.col(tag))) for df in (expected, actual))
    want = expected.select(
        *keys, F.col(commit).alias("commit_expected"),
        F.replace(F.col(tag), F.lit("v"), F.lit("")).alias("tag_expected"),
        F.lit(True).alias("__wanted"),
    ).distinct()
    got = actual.select(
        *keys, F.col(commit).alias("commit_actual"),
        F.regexp_replace(F.col(tag), "^([^v]*)v", "$1").alias("tag_actual"),
    )
    agree = F.col("commit_expected").eqNullSafe(F.col("commit_actual")) & \
        F.col("tag_expected").eqNullSafe(F.col("tag_actual"))
    status = F.when(F.col("__wanted").isNull(), "unexpected").when(agree, "pass").otherwise("fail")
    fields = [*keys, "commit_expected", "commit_actual", "tag_expected", "tag_actual", "status"]
    seen = got.join(want, keys, "left").withColumn("status", status).select(*fields)
    none = F.lit(None).cast("string")
    missing = want.join(got.select(*keys).distinct(), keys, "left_anti").select(
        *keys, "commit_expected", none.alias("commit_actual"), "tag_expected",
        none.alias("tag_actual"), F.lit("missing").alias("status"),
    )
    return seen.unionByName(missing)


def multiarch_manifest(
    images: DataFrame, keys: list[str], image: str, order: Column, arch: str = "arch"
) -> DataFrame:
    """The newest arm64 and amd64 image of each key, where both exist; arm64 comes first.

    One aggregation instead of a self join: copies of an image never pair up.
    """
    def newest(name: str) -> Column:
        return F.max_by(image, F.when(F.col(arch) == name, order))

    return (
        images.groupBy(*keys)
        .agg(newest("arm64").alias("arm64_image"), newest("amd64").alias("amd64_image"))
        .filter(F.col("arm64_image").isNotNull() & F.col("amd64_image").isNotNull())
        .withColumn("manifests", F.array("arm64_image", "amd64_image"))
    )


def images_to_sync(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return source.join(target.select(*keys).distinct(), keys, "left_anti")


def patch_targets(builds: DataFrame, product: str = "product") -> DataFrame:
    """Builds that get a patch, with the binaries that go into it."""
    p = F.col(product)
    binaries = F.lit(None).cast("string")
    for name in fixed.PATCHED_PRODUCTS:
        binaries = F.when(p == name, fixed.PATCH_BINARIES[name]).otherwise(binaries)
    return builds.filter(p.isin(*fixed.PATCHED_PRODUCTS)).withColumn("patch_binaries", binaries)


def host_label(
    product: Column, arch: Column, os: Column,
    rules: list[tuple[list[str], str, str, str]] = fixed.HOST_RULES,
) -> Column:
    """Label of the last of a handful of fixed rules that matches, as an expression."""
    out = F.lit(None).cast("string")
    for products, rule_arch, rule_os, label in rules:
        match = F.lit(True)
        if products:
            match = match & product.isin(*products)
        if rule_arch:
            match = match & (arch == rule_arch)
        if rule_os:
            match = match & (os == rule_os)
        out = F.when(F.coalesce(match, F.lit(False)), label).otherwise(out)
    return out


def last_matching_rule(
    requests: DataFrame, rules: DataFrame, fields: dict[str, str] = {"product": "products", "arch": "arch", "os": "os"},
    number: str = "rule_no", label: str = "label", out: str = "host",
) -> DataFrame:
    """``requests`` with the label of the last rule that matches, null where none does.

    ``rules`` is a table of any size: a field of a request must equal that of the rule, or be
    in it if it is a list; an empty or null field of a rule matches everything, also null. Of
    the rules that match the one with the greatest ``number`` counts, of equal numbers the
    greatest label. Rules without a number match nothing.

    Rules that leave the same fields open form a mask, in which a request has one key. The
    distinct field values of the requests are looked up once for each mask there may be, all
    by one equi-join with the last rule of each key, so no rule is compared with a request.
    """
    names = list(fields)
    # A key has a text for each field it holds, and null for each one it leaves open.
    keys = rules.filter(F.col(number).isNotNull())
    for f in names:
        of = keys.schema[fields[f]].dataType
        if of.typeName() == "array":
            given = F.filter(F.col(fields[f]), lambda x: x.isNotNull() & (x != ""))
            keys = keys.withColumn(f"__{f}", F.explode_outer(given))
        else:
            keys = keys.withColumn(f"__{f}", F.nullif(F.col(fields[f]).cast("string"), F.lit("")))
    keys = keys.select(*[F.col(f"__{f}").alias(f) for f in names], F.struct(number, label).alias("__rule")) \
        .groupBy(*names).agg(F.max("__rule").alias("__rule"))
    asked = requests.select(*[F.col(f).cast("string").alias(f) for f in names]).distinct()
    masks = F.array(*(
        F.struct(*(F.when(F.lit(bool(m >> i & 1)), F.col(f)).alias(f) for i, f in enumerate(names)),
                 F.lit(m).alias("m"))
        for m in range(1 << len(names))))
    looked = asked.select(*[F.col(f).alias(f"__a_{f}") for f in names], F.explode(masks).alias("k"))
    # A request without a value has no key in the masks that ask for it.
    looked = looked.filter(_all([
        (F.col("k.m").bitwiseAND(F.lit(1 << i)) == 0) | F.col(f"__a_{f}").isNotNull() for i, f in enumerate(names)]))
    same = _all([F.col(f"k.{f}").eqNullSafe(F.col(f"r.{f}")) for f in names])
    found = looked.join(keys.alias("r"), same).groupBy(*[f"__a_{f}" for f in names]).agg(
        F.max("__rule").alias("__rule"))
    match = _all([F.col(f"q.{f}").cast("string").eqNullSafe(F.col(f"a.__a_{f}")) for f in names])
    return requests.alias("q").join(found.alias("a"), match, "left") \
        .select("q.*", F.col(f"a.__rule.{label}").alias(out))


def lint_config_present(
    repos: DataFrame, listing: DataFrame, default: str = "default", repo: str = "repo"
) -> DataFrame:
    """The repository's own config where the listing (repo, config) has one."""
    own = listing.groupBy(F.col("repo").alias(repo)).agg(F.max("config").alias("__own"))
    return repos.join(own, repo, "left").withColumn(
        "config", F.coalesce("__own", F.lit(default))
    ).drop("__own")


def plan_executions(names: DataFrame, plans: DataFrame, triggers: DataFrame,
                    executions: DataFrame) -> DataFrame:
    """name -> first plan -> its trigger -> first execution; a miss drops the name.

    ``plans`` (query, plan_id) holds the answers of the name search, ``triggers`` is
    (name, plan_id, trigger_id), ``executions`` is (trigger_id, exec_id).
    """
    first = plans.groupBy(F.col("query").alias("name")).agg(F.min("plan_id").alias("plan_id"))
    run = executions.groupBy("trigger_id").agg(F.min("exec_id").alias("exec_id"))
    chosen = names.join(first, "name").join(
        triggers.groupBy("name", "plan_id").agg(F.max("trigger_id").alias("trigger_id")),
        ["name", "plan_id"],
    )
    return chosen.join(run, "trigger_id")


def apply_overrides(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Given commits and pull requests replace the looked-up ones.

    ``overrides`` is (product, commit, pull_request); text of at most one character
    counts as not given. One product takes its branch as its tag.
    """
    given = overrides.groupBy("product").agg(
        F.max(F.when(F.length("commit") > 1, F.col("commit"))).alias("__commit"),
        F.max(F.when(F.length("pull_request") > 1, F.col("pull_request"))).alias("__pr"),
    )
    return requests.join(given, "product", "left").withColumns({
        "commit": F.coalesce("__commit", "commit"),
        "pull_request": F.col("__pr"),
        "tag": F.when(F.col("product") == fixed.TAGGED_BY_BRANCH, F.col("branch")).otherwise(F.col("tag")),
    }).drop("__commit", "__pr")

