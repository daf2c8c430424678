"""Record layouts."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _fields(*names: str, kind: T.DataType = _S) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


CREDENTIAL = T.StructType(_fields("jenkinsID", "key"))
VAR = T.StructType(_fields("value", "key"))
RESOURCE = T.StructType(_fields("memory", "cpu"))
RESOURCES = T.StructType([T.StructField("limits", RESOURCE), T.StructField("requests", RESOURCE)])
# Receivers of a run.
NOTIFY = T.StructType(_fields("email", "lark", kind=T.ArrayType(_S)))

TASK_SPEC = T.StructType(
    _fields("id", "pipelineID", kind=T.IntegerType())
    + _fields("taskName", "checkerName", "pipelineName", "triggerEvent", "branch", "pullRequest",
              "commitID", "owner", "repo", "cacheCodeURL", "status", "jenkinsRunURL", "result")
    + _fields("retry", "timeout", kind=T.IntegerType())
    + [
        T.StructField("credentials", T.ArrayType(CREDENTIAL)),
        T.StructField("vars", T.ArrayType(VAR)),
        T.StructField("image", _S),
        T.StructField("resources", RESOURCES),
        T.StructField("params", T.MapType(_S, _S)),
    ]
)

# The empty ``triggers`` block is left out: a struct without fields cannot be stored.
PIPELINE_SPEC = T.StructType(
    _fields("id", kind=T.IntegerType())
    + _fields("pipelineName", "repo", "owner", "triggerEvent", "branch", "pullRequest",
              "commitID", "status", "jenkinsRunURL", "defaultRef")
    + [T.StructField("notify", NOTIFY), T.StructField("tasks", T.ArrayType(TASK_SPEC))]
)

LEGACY_RESOURCE = T.StructType(_fields("cpu", "mem"))
LEGACY_ENV = T.StructType(
    _fields("image")
    + [T.StructField("request", LEGACY_RESOURCE), T.StructField("limit", LEGACY_RESOURCE)]
)
SECRET_VAR = T.StructType(_fields("secretID", "key"))
LEGACY_TASK = T.StructType(
    _fields("taskType", "name", "shellScript")
    + [T.StructField("buildEnv", LEGACY_ENV),
       T.StructField("secretVar", T.ArrayType(SECRET_VAR))]
    + _fields("outputDir", "utReportDir", "covReportDir", "utReport", "covReport",
              "coverageRate", "reportDir", "testReportDir")
)
LEGACY_CONFIG = T.StructType(
    _fields("defaultRef", "notifyPolicy")
    + [T.StructField("notify", NOTIFY), T.StructField("tasks", T.ArrayType(LEGACY_TASK))]
)

# Result file: every kind of row in one layout, told apart by ``type``.
TASK_RESULT_FIELDS = [
    "name", "checkName", "type", "result", "fullDisplayName", "buildNumber", "summary",
    "durationStr", "duration", "startTime", "url",
]
RUN_RESULT_FIELDS = [
    "name", "result", "buildNumber", "type", "commitID", "branch", "pullRequest", "prID", "repo",
    "org", "url", "startTime", "duration", "triggerEvent", "receiver_lark", "receiver_email",
    "trigger",
]
NOTIFY_RESULT_FIELDS = ["name", "type", "lark", "email"]
RUN_TYPES = ["TiPipeline", "dailyci-pipeline", "verifyci-pipeline"]
NOTIFY_TYPE = "ci-notify"
CI_RESULT = T.StructType(
    _fields("name", "checkName", "type", "result", "fullDisplayName", "buildNumber", "summary",
            "durationStr")
    + _fields("duration", "startTime", kind=T.LongType())
    + _fields("url", "commitID", "branch", "pullRequest", "prID", "repo", "org", "triggerEvent",
              "trigger")
    + _fields("receiver_lark", "receiver_email", "lark", "email", kind=T.ArrayType(_S))
)

IT_SUBTASKS = T.ArrayType(T.StructType(_fields("status")))
IMAGE_TAGS = T.ArrayType(T.StructType(_fields("name")))

JUNIT_MARK = T.StructType(_fields("_VALUE", "_message", "_type"))
JUNIT_CASE = T.StructType(
    _fields("_classname", "_name")
    + _fields("_time", kind=T.DoubleType())
    + _fields("failure", "error", "skipped", kind=JUNIT_MARK)
)
COBERTURA_LINE = T.StructType(
    _fields("_VALUE") + _fields("_number", "_hits", kind=T.LongType())
)
COBERTURA_CLASS = T.StructType(
    _fields("_filename", "_name")
    + [T.StructField("lines", T.StructType([T.StructField("line", T.ArrayType(COBERTURA_LINE))]))]
)
COVERAGE_TOTALS = T.StructType([T.StructField("commit", T.StructType([
    T.StructField("totals", T.StructType(
        _fields("c") + _fields("f", "n", "h", "m", "p", kind=T.LongType())
        + [T.StructField("diff", T.ArrayType(_S))]
    ))
]))])

# Build descriptor: one product on one branch.
BUILD_INFO = T.StructType(_fields(
    "repo", "sha1", "actualRepo", "binaryAmd64", "binaryArm64", "binaryAmd64Failpoint",
    "binaryArm64Failpoint", "dockerfileAmd64", "dockerfileArm64", "dockerfileForDebugAmd64",
    "imageName", "imageNameEnableFailpoint", "imageNameForDebug",
    "imageNameForDebugEnableFailpoint", "imageNameAmd64", "imageNameArm64",
))

HOTFIX_RESULT = T.StructType(
    _fields("repo", "tag")
    + [T.StructField("results", T.MapType(_S, T.MapType(_S, _S)))]
    + _fields("ci_url", "commit_id")
)

BUILD_REQUEST = T.StructType(
    _fields("REPO", "PRODUCT", "ARCH", "OS", "EDITION", "GIT_HASH", "GIT_PR", "RELEASE_TAG",
            "TARGET_BRANCH", "TIDB_HASH", "USE_TIFLASH_RUST_CACHE", "OUTPUT_BINARY")
    + _fields("FORCE_REBUILD", "FAILPOINT", "NEED_SOURCE_CODE", kind=T.BooleanType())
)
