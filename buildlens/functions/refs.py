"""Repository, branch and author names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.site import DEFAULT_SITE, Site


def split_repo(c: Column, unmatched: str = "blank") -> Column:
    """``owner/repo`` to struct(owner, repo); empty parts at the end do not count.

    Anything but two parts gives two empty strings (``blank``) or leaves the name
    as it is without an owner (``keep``).
    """
    parts = F.split(F.regexp_replace(c, "/+$", ""), "/")
    two = F.coalesce(F.size(parts) == 2, F.lit(False))
    if unmatched == "blank":
        owner, repo = F.lit(""), F.lit("")
    else:
        owner, repo = F.lit(None).cast("string"), c
    return F.struct(
        F.when(two, F.get(parts, F.lit(0))).otherwise(owner).alias("owner"),
        F.when(two, F.get(parts, F.lit(1))).otherwise(repo).alias("repo"),
    )


def normalize_ref(c: Column) -> Column:
    return F.when(
        c.startswith(fixed.HEADS_PREFIX), F.replace(c, F.lit(fixed.HEADS_PREFIX), F.lit(""))
    ).otherwise(c)


def resolve_trigger(trigger_author: Column, author: Column, legacy: bool = False) -> Column:
    if legacy:  # only the empty string is replaced, null stays null
        return F.when(trigger_author == "", author).otherwise(trigger_author)
    return F.coalesce(F.nullif(trigger_author, F.lit("")), author)


def release_tag_for_branch(c: Column) -> Column:
    version = F.regexp_extract(c, f"^{fixed.RELEASE_PREFIX}([^-]*)", 1)
    return F.when(
        c.startswith(fixed.RELEASE_PREFIX), F.concat(F.lit("v"), version, F.lit(".0-nightly"))
    ).otherwise(F.lit(fixed.MASTER_RELEASE_TAG))


def image_tag(c: Column, kind: str) -> Column:
    if kind == "branch":
        return F.replace(c, F.lit("/"), F.lit("-"))
    if kind == "pre_release":
        return F.concat(c, F.lit("-pre"))
    raise ValueError(f"unknown image tag kind {kind!r}")


def git_remote(repo: Column, site: Site = DEFAULT_SITE) -> Column:
    org = (
        F.when(repo.isin(*fixed.REPOS_OF_OWN_ORG), F.lit(fixed.OWN_ORG))
        .when(repo.isin(*fixed.INNER_ORG_REPOS), F.lit(site.inner_org))
        .otherwise(F.lit(site.org))
    )
    return F.concat(F.lit(f"{site.git_host}:"), org, F.lit("/"), repo, F.lit(".git"))


def ref_spec(pull_request: Column, branch: Column | None = None) -> Column:
    """What to fetch: the pull request, else one branch, else all branches."""
    heads = F.lit("+refs/heads/*:refs/remotes/origin/*")
    if branch is not None:
        heads = F.concat(
            F.lit("+refs/heads/"), branch, F.lit(":refs/remotes/origin/"), branch
        )
    pr = F.concat(
        F.lit("+refs/pull/"), pull_request, F.lit("/*:refs/remotes/origin/pr/"),
        pull_request, F.lit("/*"),
    )
    return F.when(F.length(pull_request) >= 1, pr).otherwise(heads)


def lint_config_url(repo: Column, site: Site = DEFAULT_SITE) -> Column:
    return F.concat(F.lit(f"{site.config_base}/main/"), repo, F.lit("/golangci-lint.yaml"))


def repo_config_url(repo: Column, event: Column, site: Site = DEFAULT_SITE) -> Column:
    """Daily configs sit on one branch of the config repository, the others on another."""
    line = F.when(event == "daily", F.lit("master")).otherwise(F.lit("main"))
    return F.concat(
        F.lit(f"{site.config_base}/"), line, F.lit("/"), repo, F.lit("/"), event, F.lit(".yaml")
    )


def default_if_short(c: Column, other: Column, n: int) -> Column:
    """``other`` where the text has at most ``n`` characters or is missing."""
    return F.when(F.length(c) > n, c).otherwise(other)


def url_encode_plan(c: Column) -> Column:
    return F.url_encode(c)
