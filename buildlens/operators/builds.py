"""What a build of one product on one branch consists of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import fixed, schemas
from buildlens.functions import artifacts
from buildlens.operators import joins
from buildlens.site import DEFAULT_SITE, Site


def build_info(
    df: DataFrame, product: str = "product", branch: str = "branch", sha: str = "sha",
    site: Site = DEFAULT_SITE,
) -> DataFrame:
    """Adds the paths and names of a nightly build as ``info``."""
    p, b, s = F.col(product), F.col(branch), F.col(sha)
    alias, dockerfile = fixed.IMAGE_ALIAS

    def binary(arch: str, failpoint: bool = False) -> Column:
        return artifacts.artifact_path(
            "nightly", product=p, commit=s, version=b, arch=F.lit(arch), failpoint=failpoint,
            site=site)

    def recipe(folder: str, name: Column) -> Column:
        return F.concat(F.lit(f"{site.dockerfile_base}/{folder}/"), name)

    def image(variant: str = "") -> Column:
        return artifacts.nightly_image(p, b, variant, site)

    built = F.when(p == alias, dockerfile).otherwise(p)
    fields = {
        "repo": p, "sha1": s, "actualRepo": joins.effective_repo(p, b, "nightly"),
        "binaryAmd64": binary("amd64"), "binaryArm64": binary("arm64"),
        "binaryAmd64Failpoint": binary("amd64", True),
        "binaryArm64Failpoint": binary("arm64", True),
        "dockerfileAmd64": recipe("linux-amd64", built),
        "dockerfileArm64": recipe("linux-arm64", built),
        "dockerfileForDebugAmd64": recipe("debug-image", p),
        "imageName": image(), "imageNameEnableFailpoint": image("failpoint"),
        "imageNameForDebug": image("debug"),
        "imageNameForDebugEnableFailpoint": image("debug-failpoint"),
        "imageNameAmd64": image("linux-amd64"), "imageNameArm64": image("linux-arm64"),
    }
    return df.withColumn("info", F.struct(*[fields[n].alias(n) for n in schemas.BUILD_INFO.names]))


def prerelease_images(
    df: DataFrame, need_debug: bool = True, site: Site = DEFAULT_SITE
) -> DataFrame:
    """One row per image list that a pre-release build (product, arch, failpoint, tag) pushes."""
    p, a, f, t = map(F.col, ["product", "arch", "failpoint", "tag"])
    source, second = fixed.PRERELEASE_SECOND_IMAGE
    amd64 = (a == "amd64") & F.lit(need_debug)

    def entry(kind: str, name: Column, images: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(kind).alias("kind"), name.alias("image_of"), images.alias("images")))

    lists = F.array_compact(F.array(
        entry("release", p, artifacts.prerelease_image(p, a, t, f, site), F.lit(True)),
        entry("debug", p, artifacts.prerelease_debug_image(p, t, f, site),
              amd64 & p.isin(*fixed.PRERELEASE_DEBUG)),
        entry("release", F.lit(second),
              artifacts.prerelease_image(F.lit(second), a, t, False, site), p == source),
        entry("debug", F.lit(second),
              artifacts.prerelease_debug_image(F.lit(second), t, False, site),
              amd64 & (p == source)),
    ))
    return df.withColumn("__list", F.explode(lists)).select(*df.columns, "__list.*")
