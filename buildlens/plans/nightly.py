"""Whole flows: what a night builds, and what a pre-release pushes."""

from pyspark.sql import functions as F

from buildlens.functions import artifacts
from buildlens.operators import builds, filters, joins, matrix
from buildlens.plans.registry import Inputs, query

_REPO = """CASE WHEN product = 'br' AND (branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.2')) THEN 'tidb'
       WHEN product = 'dumpling' AND (branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.3')) THEN 'tidb'
       WHEN product IN ('ticdc', 'dm') THEN 'tiflow'
       WHEN product = 'tidb-lightning' THEN CASE WHEN branch = 'master' OR (starts_with(branch, 'release-') AND branch >= 'release-5.2') THEN 'tidb' ELSE 'br' END
       ELSE product END"""
_BASE = "'https://raw.acme.example/ci/main/Dockerfile/release/"
_PATH = ("concat('builds/acme/qa-daily-image-build/', packed, '/', branch, '/', sha, '/centos7/', packed, '-linux-', '{arch}', "
         "'{failpoint}', '.tar.gz')")


def _path(arch: str, failpoint: str = "") -> str:
    return _PATH.format(arch=arch, failpoint=failpoint)


def _any_path(failpoint: str) -> str:
    """The path by the column ``arch`` and a condition for failpoint files."""
    return " ".join(
        ["CASE"] + [f"WHEN arch = '{arch}' AND {cond} THEN {_path(arch, suffix)}"
                    for arch in ("amd64", "arm64")
                    for cond, suffix in ((f"({failpoint})", "-failpoint"), (f"NOT ({failpoint})", ""))]
        + ["END"])


@query("d10_build_info", f"""
WITH asked AS (SELECT artifact_id, product, branch, sha, CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END AS packed,
                      CASE WHEN product = 'tics' THEN 'tiflash' ELSE product END AS file FROM image_versions)
SELECT artifact_id, product AS repo, sha AS sha1, {_REPO} AS "actualRepo",
  {_path('amd64')} AS "binaryAmd64", {_path('arm64')} AS "binaryArm64",
  {_path('amd64', '-failpoint')} AS "binaryAmd64Failpoint", {_path('arm64', '-failpoint')} AS "binaryArm64Failpoint",
  concat({_BASE}linux-amd64/', file) AS "dockerfileAmd64", concat({_BASE}linux-arm64/', file) AS "dockerfileArm64",
  concat({_BASE}debug-image/', product) AS "dockerfileForDebugAmd64",
  concat('hub.acme.example/qa/', product, ':', branch) AS "imageName",
  concat('hub.acme.example/qa/', product, ':', branch, '-failpoint') AS "imageNameEnableFailpoint",
  concat('hub.acme.example/qa/', product, ':', branch, '-debug') AS "imageNameForDebug",
  concat('hub.acme.example/qa/', product, ':', branch, '-debug-failpoint') AS "imageNameForDebugEnableFailpoint",
  concat('hub.acme.example/qa/', product, ':', branch, '-linux-amd64') AS "imageNameAmd64",
  concat('hub.acme.example/qa/', product, ':', branch, '-linux-arm64') AS "imageNameArm64"
FROM asked
""")
def build_info(t: Inputs):
    return builds.build_info(t.view("image_versions")).select("artifact_id", "info.*")


@query("x1_prerelease_images", """
WITH asked AS (SELECT artifact_id, product, arch, failpoint, tag FROM image_versions),
lists AS (
  SELECT *, 'release' AS kind, product AS image_of, failpoint AS f FROM asked
  UNION ALL SELECT *, 'debug', product, failpoint FROM asked WHERE arch = 'amd64' AND product IN ('dumpling', 'ticdc', 'tidb-binlog', 'tidb', 'tikv', 'pd')
  UNION ALL SELECT *, 'release', 'tidb-lightning', false FROM asked WHERE product = 'br'
  UNION ALL SELECT *, 'debug', 'tidb-lightning', false FROM asked WHERE product = 'br' AND arch = 'amd64'),
named AS (SELECT *, concat(CASE image_of WHEN 'tics' THEN 'tiflash' WHEN 'monitoring' THEN 'tidb-monitor-initializer' ELSE image_of END,
                           CASE WHEN arch = 'arm64' THEN '-arm64' ELSE '' END) AS n FROM lists)
SELECT artifact_id, kind, image_of,
  CASE WHEN kind = 'debug' THEN concat('hub.acme.example/qa/', image_of, ':', tag, '-pre', CASE WHEN f THEN '-failpoint' ELSE '' END, '-debug')
       WHEN f THEN concat('hub.acme.example/qa/', n, ':', tag, '-pre-failpoint')
       ELSE concat('hub.acme.example/qa/', n, ':', tag, '-pre,acme/', n, ':', tag, '-pre') END AS images
FROM named
""")
def prerelease_images(t: Inputs):
    entries = t.view("image_versions").select("artifact_id", "product", "arch", "failpoint", "tag")
    return builds.prerelease_images(entries).select("artifact_id", "kind", "image_of", "images")


@query("nightly_pending_builds", f"""
WITH latest AS (SELECT repo, ref, arg_max(sha, seen) AS sha FROM heads GROUP BY 1, 2),
multi AS (SELECT unnest(['tidb', 'tikv', 'pd', 'br', 'tidb-lightning', 'ticdc', 'dumpling', 'tidb-binlog', 'tics']) AS product),
fail AS (SELECT unnest(['tidb', 'pd', 'tikv', 'br', 'tidb-lightning']) AS product),
refs AS (SELECT DISTINCT branch FROM branches),
entries AS (
  SELECT branch, product, 'normal' AS kind FROM refs, multi
  UNION ALL SELECT branch, product, 'normal' FROM refs, (SELECT unnest(['dm', 'ng-monitoring']) AS product) n WHERE branch >= 'release-5.3' OR branch = 'master'
  UNION ALL SELECT branch, product, 'failpoint' FROM refs, fail
  UNION ALL SELECT branch, 'monitoring', 'monitoring' FROM refs WHERE branch = 'master'),
moved AS (SELECT *, {_REPO} AS repo, CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END AS packed FROM entries),
found AS (SELECT m.*, l.sha FROM moved m LEFT JOIN latest l ON l.repo = m.repo AND l.ref = m.branch),
paths AS (SELECT *, {_any_path("kind = 'failpoint'")} AS path FROM found, (SELECT unnest(['amd64', 'arm64']) AS arch) a WHERE length(sha) = 40),
stored AS (SELECT {_any_path("failpoint")} AS path
           FROM (SELECT *, CASE WHEN product = 'tidb-lightning' THEN 'br' ELSE product END AS packed FROM image_versions) v)
SELECT branch, product, kind, arch, repo, sha AS commit, path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = p.path)
UNION ALL SELECT branch, product, kind, NULL, repo, sha, NULL FROM found WHERE sha IS NULL OR length(sha) <> 40
""")
def nightly_pending_builds(t: Inputs):
    """Branches of the farm -> matrix -> repository -> commit -> paths -> what is not stored yet.

    Entries whose commit is none are returned as well, without arch and path.
    """
    branches = t.view("branches").select("branch").distinct()
    entries = matrix.nightly_matrix(branches).withColumn(
        "repo", joins.effective_repo(F.col("product"), F.col("branch"), "nightly"))
    resolved = joins.resolve_commit(entries, t.view("heads"), F.col("seen"), ref="branch")
    good, bad = filters.split_valid_commits(resolved, "commit")

    def path(commit: str, failpoint):
        return artifacts.artifact_path(
            "nightly", product=F.col("product"), commit=F.col(commit), version=F.col("branch"),
            arch=F.col("arch"), failpoint=failpoint).alias("path")

    both = good.withColumn("arch", F.explode(F.array(F.lit("amd64"), F.lit("arm64"))))
    requests = both.select(
        "branch", "product", "kind", "arch", "repo", "commit",
        path("commit", F.col("kind") == "failpoint"), F.lit(False).alias("force"))
    stored = t.view("image_versions").select(path("sha", F.col("failpoint")))
    pending = joins.pending_builds(requests, stored, ["path"]).drop("force")
    none = F.lit(None).cast("string")
    return pending.unionByName(bad.select(
        "branch", "product", "kind", none.alias("arch"), "repo", "commit", none.alias("path")))
