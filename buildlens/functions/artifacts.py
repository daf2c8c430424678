"""Paths of build results and names of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed
from buildlens.site import DEFAULT_SITE, Site



def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _renamed(c: Column, pair: tuple[str, str]) -> Column:
    return F.when(c == pair[0], pair[1]).otherwise(c)


def _flag(on: Column | bool, text: str) -> Column:
    on = F.lit(on) if isinstance(on, bool) else on
    return F.when(on, text).otherwise("")


def artifact_path(
    kind: str,
    *,
    product: Column,
    commit: Column,
    version: Column | None = None,
    arch: Column | None = None,
    failpoint: Column | bool = False,
    debug: Column | bool = False,
    site: Site = DEFAULT_SITE,
) -> Column:
    """Where a build result is stored. ``version`` is the tag or the branch."""
    org = site.org
    if kind in ("code_cache", "atom_build"):
        folder = {"code_cache": "cachecode", "atom_build": "atom-build"}[kind]
        return _cat(f"builds/{org}/devops/{folder}/", product, "/", commit, "/", product, ".tar.gz")
    if kind in ("hotfix", "hotfix_patch"):
        patch = "-patch" if kind == "hotfix_patch" else ""
        return _cat(
            "builds/hotfix", _flag(debug, "-debug"), "/", product, "/", version, "/", commit,
            "/centos7/", product, f"{patch}-linux-", arch, ".tar.gz",
        )
    if kind == "nightly":
        packed = _renamed(product, fixed.PACKED_WITH)
        return _cat(
            f"builds/{org}/qa-daily-image-build/", packed, "/", version, "/", commit,
            "/centos7/", packed, "-linux-", arch, _flag(failpoint, "-failpoint"), ".tar.gz",
        )
    if kind == "pre_release":
        return _cat(
            f"builds/{org}/", product, "/test/", _flag(failpoint, "failpoint/"), version, "/",
            commit, "/linux-", arch, "/", product, ".tar.gz",
        )
    if kind == "single_image":
        return _cat(
            f"builds/{org}/", product, "/test/", version, "/", commit, "/linux-amd64/",
            product, ".tar.gz",
        )
    if kind == "arm_test":
        return _cat(f"builds/{org}/", product, "/test/", commit, "/linux-arm64/", product, ".tar.gz")
    raise ValueError(f"unknown artifact kind {kind!r}")


# Layout name, pattern, and the group that holds each field. Pre-release and
# single-image paths share a layout, so both read as ``release_test``.
_LAYOUTS = [
    ("code_cache", r"^builds/[^/]+/devops/cachecode/([^/]+)/([^/]+)/[^/]+\.tar\.gz$",
     {"product": 1, "commit": 2}),
    ("atom_build", r"^builds/[^/]+/devops/atom-build/([^/]+)/([^/]+)/[^/]+\.tar\.gz$",
     {"product": 1, "commit": 2}),
    ("hotfix",
     r"^builds/hotfix(-debug)?/([^/]+)/([^/]+)/([^/]+)/centos7/.+?(-patch)?-(linux)-(amd64|arm64)\.tar\.gz$",
     {"debug": 1, "product": 2, "version": 3, "commit": 4, "patch": 5, "os": 6, "arch": 7}),
    ("nightly",
     r"^builds/[^/]+/qa-daily-image-build/([^/]+)/(.+)/([^/]+)/centos7/.+?-(linux)-(amd64|arm64)(-failpoint)?\.tar\.gz$",
     {"product": 1, "version": 2, "commit": 3, "os": 4, "arch": 5, "failpoint": 6}),
    ("release_test",
     r"^builds/[^/]+/([^/]+)/test/(failpoint/)?(.+)/([^/]+)/(linux|darwin)-(amd64|arm64)/[^/]+\.tar\.gz$",
     {"product": 1, "failpoint": 2, "version": 3, "commit": 4, "os": 5, "arch": 6}),
    ("arm_test", r"^builds/[^/]+/([^/]+)/test/([^/]+)/(linux)-(arm64)/[^/]+\.tar\.gz$",
     {"product": 1, "commit": 2, "os": 3, "arch": 4}),
]


def parse_artifact_path(c: Column) -> Column:
    """The inverse of :func:`artifact_path`; a path of no layout gives null fields."""

    layout = F.lit(None).cast("string")
    for name, pattern, _ in reversed(_LAYOUTS):
        layout = F.when(c.rlike(pattern), name).otherwise(layout)

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for kind, pattern, groups in _LAYOUTS:
            if name in groups:
                part = F.regexp_extract(c, pattern, groups[name])
                out = F.when(layout == kind, part).otherwise(out)
        return F.nullif(out, F.lit(""))

    return F.struct(
        layout.alias("layout"),
        *[field(n).alias(n) for n in ("product", "version", "commit", "os", "arch")],
        *[F.when(layout.isNotNull(), field(n).isNotNull()).alias(n)
          for n in ("failpoint", "debug", "patch")],
    )


def prerelease_image(
    product: Column, arch: Column, tag: Column, failpoint: Column | bool = False,
    site: Site = DEFAULT_SITE,
) -> Column:
    """Comma list of the images of a pre-release build."""
    failpoint = F.lit(failpoint) if isinstance(failpoint, bool) else failpoint
    name = product
    for pair in fixed.IMAGE_NAMES.items():
        name = F.when(product == pair[0], pair[1]).otherwise(name)
    name = _cat(name, F.when(arch == "arm64", "-arm64").otherwise(""))
    inner = _cat(f"{site.registry}/qa/", name, ":", tag, "-pre")
    return F.when(failpoint, _cat(inner, "-failpoint")).otherwise(
        _cat(inner, f",{site.org}/", name, ":", tag, "-pre")
    )


def prerelease_debug_image(
    product: Column, tag: Column, failpoint: Column | bool = False, site: Site = DEFAULT_SITE
) -> Column:
    return _cat(
        f"{site.registry}/qa/", product, ":", tag, "-pre", _flag(failpoint, "-failpoint"), "-debug"
    )


def nightly_image(
    product: Column, branch: Column, variant: str = "", site: Site = DEFAULT_SITE
) -> Column:
    """``variant`` is one of '', failpoint, debug, debug-failpoint, linux-amd64, linux-arm64."""
    suffix = f"-{variant}" if variant else ""
    return _cat(f"{site.registry}/qa/", product, ":", branch, suffix)


def hotfix_image(
    product: Column, arch: Column, tag: Column, debug: bool = False, site: Site = DEFAULT_SITE
) -> Column:
    project = "ee-debug" if debug else "qa"
    return _cat(
        f"{site.registry}/{project}/", product, F.when(arch == "arm64", "-arm64").otherwise(""),
        ":", tag, "-debug" if debug else "",
    )


def scanned_images(site: Site = DEFAULT_SITE) -> list[str]:
    """The images that are scanned for vulnerabilities."""
    return [f"{site.registry}/qa/{p}:{fixed.NEWEST_BRANCH}" for p in fixed.SCANNED_PRODUCTS]


def package_mode(product: Column, tag: Column, need_source: Column) -> Column:
    """Whether the sources are packed with the output."""
    untagged = F.length(F.coalesce(tag, F.lit(""))) < 1
    with_source = (
        F.coalesce(need_source, F.lit(False))
        | (product.isin(*fixed.UNTAGGED_WITH_SOURCE) & untagged)
        | product.isin(*fixed.ALWAYS_WITH_SOURCE)
    )
    return F.when(with_source, "with_source").otherwise("output_only")


def build_alias(product: Column, repo: Column, flow: str) -> Column:
    """Under which (repo, product) a build is started, and whether it carries sources."""
    if flow == "nightly":
        return F.struct(
            repo.alias("repo"),
            _renamed(product, fixed.PACKED_WITH).alias("product"),
            F.lit(False).alias("need_source"),
        )
    if flow == "hotfix":
        name, built_as = fixed.HOTFIX_BUILD_NAME
        return F.struct(
            F.when(product == name, built_as).otherwise(repo).alias("repo"),
            F.when(product == name, built_as).otherwise(product).alias("product"),
            product.isin(*fixed.HOTFIX_WITH_SOURCE).alias("need_source"),
        )
    raise ValueError(f"unknown flow {flow!r}")
