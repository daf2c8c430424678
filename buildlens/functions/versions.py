"""Version comparison and what depends on it.

Versions are strings and compare character by character: ``v10.0.0`` sorts before
``v5.3.0``. ``mode='semantic'`` compares the numbers instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed

def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


_DIGITS = 9


def semantic_key(c: Column) -> Column:
    """All numbers of a version, of any size, as text whose order is that of the numbers.

    A number is written as the count of its digits and the digits; zeros at the end of a
    version do not count. The key is costly: compute it once as a column, and compare that
    with ``version_gate(..., mode="key")``.
    """
    numbers = F.split(F.regexp_replace(c, r"^\D+|\D+$", ""), r"\D+")
    sized = F.transform(numbers, lambda x: F.concat(
        F.lpad(F.length(F.ltrim(x, F.lit("0"))).cast("string"), _DIGITS, "0"), F.ltrim(x, F.lit("0"))))
    return F.regexp_replace(F.array_join(sized, "."), rf"((^|\.)0{{{_DIGITS}}})+$", "")


def key_of(version: str) -> str:
    """The same key of a known version."""
    numbers = [x.lstrip("0") for x in re.findall("[0-9]+", version)]
    while numbers and not numbers[-1]:
        numbers.pop()
    return ".".join(f"{len(x):0{_DIGITS}d}{x}" for x in numbers)


def version_gate(c: Column, op: str, bound: str, mode: str = "lexical") -> Column:
    """Compare a version with a bound; with ``key`` the column holds keys already."""
    if mode not in ("lexical", "semantic", "key"):
        raise ValueError(f"unknown mode {mode!r}")
    left = semantic_key(c) if mode == "semantic" else c
    right = F.lit(bound if mode == "lexical" else key_of(bound))
    return {
        ">=": left >= right, ">": left > right,
        "<=": left <= right, "<": left < right,
        "==": left == right,
    }[op]


def toolchain_tier(tag: Column, branch: Column, repo: Column) -> Column:
    """Compiler line of a build; the first rule that holds decides."""
    tag, branch, repo = _blank(tag), _blank(branch), _blank(repo)
    tagged, released = tag.startswith("v"), branch.startswith(fixed.RELEASE_PREFIX)
    special = repo.isin(*fixed.MIDDLE_TOOLCHAIN_REPOS)
    for prefix in fixed.MIDDLE_TOOLCHAIN_BRANCH_PREFIXES:
        special = special | branch.startswith(prefix)
    return (
        F.when(tagged & (tag <= fixed.MIDDLE_TOOLCHAIN_TAG), fixed.OLD_TOOLCHAIN)
        .when(tagged & (tag < fixed.NEW_TOOLCHAIN_TAG), fixed.MIDDLE_TOOLCHAIN)
        .when(released & (branch < fixed.MIDDLE_TOOLCHAIN_BRANCH), fixed.OLD_TOOLCHAIN)
        .when(released & (branch < fixed.NEW_TOOLCHAIN_BRANCH), fixed.MIDDLE_TOOLCHAIN)
        .when(special, fixed.MIDDLE_TOOLCHAIN)
        .otherwise(fixed.NEW_TOOLCHAIN)
    )


def hotfix_toolchain(repo: Column, tag: Column, strict_reference: bool = True) -> Column:
    """Image for a hotfix build.

    The rule drops the first letter of the tag but compares with a bound that still
    has it, so the newer image is never chosen for Go repositories. With
    ``strict_reference=False`` the whole tag is compared.
    """
    version = F.substr(tag, F.lit(2)) if strict_reference else tag
    newer = F.coalesce(version >= fixed.HOTFIX_NEW_IMAGE_FROM, F.lit(False))
    return F.when(
        repo.isin(*fixed.HOTFIX_GO_REPOS) & ~newer, fixed.HOTFIX_OLD_IMAGE
    ).otherwise(fixed.HOTFIX_NEW_IMAGE)


def valid_commit(c: Column) -> Column:
    """Exactly 40 characters; whether they are hexadecimal is not asked."""
    return F.coalesce(F.length(c) == 40, F.lit(False))


def valid_hotfix_tag(c: Column) -> Column:
    return F.coalesce(c.startswith("v") & c.contains(fixed.HOTFIX_MARK), F.lit(False))


def is_prerelease(c: Column) -> Column:
    marked = F.lit(False)
    for mark in fixed.PRERELEASE_MARKS:
        marked = marked | c.contains(mark)
    return F.coalesce(marked, F.lit(False))


def dm_web_ui(tag: Column) -> Column:
    old = (tag.startswith(fixed.RELEASE_PREFIX) & (tag < fixed.WEB_UI_FROM_BRANCH)) | (
        tag.startswith("v") & (tag < fixed.WEB_UI_FROM_TAG)
    )
    return ~F.coalesce(old, F.lit(False))


def node_package(os: Column, arch: Column) -> Column:
    out = F.lit(fixed.NODE_PACKAGE_DEFAULT)
    for for_os, for_arch, package in fixed.NODE_PACKAGES:
        out = F.when((os == for_os) & (arch == for_arch), package).otherwise(out)
    return out
