"""Lists, tables and constants that results depend on."""

# Plan execution states.
FINAL_STATES = ["SUCCESS", "FAILURE", "SKIPPED", "OMITTED", "TIMEOUT", "CANCELLED", "ERROR"]
ERROR_STATES = ["FAILURE", "TIMEOUT", "CANCELLED", "ERROR"]

# Task types each event accepts.
TASK_TYPES = {
    "daily": [
        "build", "unit-test", "lint", "cyclo", "gosec", "common",
        "jenkins-it-trigger", "atom-tcms", "atom-ut-codecov",
    ],
    "merge": ["build", "unit-test", "lint", "cyclo", "gosec", "common"],
    "verify": ["build", "unit-test", "lint", "cyclo", "gosec", "common"],
}

# Products that have a build script.
BUILDABLE_PRODUCTS = [
    "tidb-ctl", "tidb", "tidb-binlog", "pd", "tidb-tools", "ticdc", "dm", "br",
    "dumpling", "ng-monitoring", "tidb-enterprise-tools", "tics", "tikv",
    "importer", "monitoring", "tiem", "tidb-test", "enterprise-plugin",
]

# Task defaults.
DEFAULT_TIMEOUT_MINUTES = 60
MAX_RETRY = 10
DEFAULT_CPU = "1000m"
DEFAULT_MEMORY = "2Gi"
LEGACY_BUILD_CPU = "4"
LEGACY_BUILD_MEMORY = "8Gi"
DEFAULT_LINT_REPORT = "golangci-lint-report.xml"

# Waiting limits, in seconds.
DAILY_ROUND_WAIT_SECONDS = 115200
DAILY_REPORT_WAIT_SECONDS = 82800

# Quality gates.
COVERAGE_TARGET = 50
COMPLEXITY_LIMIT = 10
HISTORY_BUILDS = 10
REPORTED_SEVERITIES = ["HIGH", "CRITICAL"]
EXCLUDED_RULES = ["G103", "G104", "G204", "G307", "G401", "G404", "G501", "G505", "G601"]
SCANNED_PRODUCTS = [
    "dumpling", "br", "ticdc", "tidb-binlog", "tics", "tidb", "tikv", "pd", "tidb-lightning",
]

# Release tag of branches without a version.
MASTER_RELEASE_TAG = "v6.1.0-nightly"

# Repository moves as (product, first branch, first tag, repository).
# An empty bound means that the product has always lived there.
REPO_MOVES = [
    ("br", "release-5.2", "v5.2.0", "tidb"),
    ("dumpling", "release-5.3", "v5.3.0", "tidb"),
    ("ticdc", "", "", "tiflow"),
]
NIGHTLY_REPO_MOVES = REPO_MOVES + [
    ("dm", "", "", "tiflow"),
    ("tidb-lightning", "release-5.2", "v5.2.0", "tidb"),
]

# Binaries a product ships.
PRODUCT_BINARIES = {
    "pd": ["/pd-server"],
    "tikv": ["/tikv-server"],
    "tidb": ["/tidb-server"],
    "br": ["/br"],
    "dumpling": ["/dumpling"],
    "tidb-binlog": ["/pump", "/drainer"],
    "ticdc": ["/cdc"],
    "tidb-lightning": ["/tidb-lightning", "/tikv-importer", "/br"],
    "dm": ["/dm-master", "/dm-worker", "/dmctl"],
}

# Products that get a patch, and the binaries in it.
PATCHED_PRODUCTS = ["tikv", "tidb", "pd", "ticdc"]
PATCH_BINARIES = {
    "tidb": "tidb-server",
    "tikv": "tikv-server",
    "ticdc": "cdc",
    "dm": "dm-master,dm-worker,dmctl",
    "pd": "pd-server",
    "tiflash": "",
    "tidb-binlog": "pump,drainer,reparo,binlogctl",
}

# Build matrices.
PRERELEASE_PRODUCTS = [
    "dumpling", "br", "ticdc", "tidb-binlog", "tics", "tidb", "tikv", "pd", "monitoring",
]
PRERELEASE_FAILPOINT = ["tidb", "pd", "tikv"]
NIGHTLY_PRODUCTS = [
    "tidb", "tikv", "pd", "br", "tidb-lightning", "ticdc", "dumpling", "tidb-binlog",
]
NIGHTLY_NEWER_PRODUCTS = ["dm", "ng-monitoring"]
NIGHTLY_FAILPOINT = ["tidb", "pd", "tikv", "br", "tidb-lightning"]
TIUP_PRODUCTS = ["tidb", "tikv", "pd", "tidb-binlog"]
TIUP_PLATFORMS = ["linux-amd64", "linux-arm64", "darwin-amd64"]
ARM_BINARY_PRODUCTS = ["tidb", "tidb-test", "tikv", "pd"]

# Build host rules as (products, arch, os, label); the last rule
# that matches wins, an empty field matches everything.
HOST_RULES = [
    ([], "", "", "go"),
    (["tikv", "importer"], "", "", "build"),
    (["tics"], "", "", "build_tiflash"),
    ([], "arm64", "linux", "arm"),
    (["tics"], "arm64", "linux", "tiflash_build_arm"),
    (["tidb", "enterprise-plugin"], "arm64", "linux", "go"),
    ([], "amd64", "darwin", "mac"),
    ([], "arm64", "darwin", "mac-arm"),
    (["tics"], "arm64", "darwin", "mac-arm-tiflash"),
]

# Parameters a build job requires.
REQUIRED_BUILD_FIELDS = ["REPO", "PRODUCT", "ARCH", "OS", "GIT_HASH", "EDITION"]

# Refs.
HEADS_PREFIX = "refs/heads/"
RELEASE_PREFIX = "release-"
NEWEST_BRANCH = "master"
# Fixed values: (repository, ref asked for, ref that exists).
HEAD_REF_EXCEPTION = ("ng-monitoring", "master", "main")

# Repositories outside the main organisation.
REPOS_OF_OWN_ORG = ["tikv", "importer", "pd"]
OWN_ORG = "tikv"
INNER_ORG_REPOS = ["tiem"]

# Compiler lines, and the versions at which they change.
OLD_TOOLCHAIN = "1.13"
MIDDLE_TOOLCHAIN = "1.16"
NEW_TOOLCHAIN = "1.18"
MIDDLE_TOOLCHAIN_TAG = "v5.1"
NEW_TOOLCHAIN_TAG = "v6.0"
MIDDLE_TOOLCHAIN_BRANCH = "release-5.1"
NEW_TOOLCHAIN_BRANCH = "release-6.0"
MIDDLE_TOOLCHAIN_BRANCH_PREFIXES = ["hz-poc", "arm-dup"]
MIDDLE_TOOLCHAIN_REPOS = ["tiem"]

# Images of hotfix builds.
HOTFIX_GO_REPOS = ["tidb", "pd", "tiflow"]
HOTFIX_NEW_IMAGE_FROM = "v5.2.0"
HOTFIX_OLD_IMAGE = "imagego1.13.7"
HOTFIX_NEW_IMAGE = "imagego1.16.0"

# Web interface and its packages.
WEB_UI_FROM_BRANCH = "release-6.0"
WEB_UI_FROM_TAG = "v6.0.0"
NODE_PACKAGES = [
    ("linux", "arm64", "node-v16.14.0-linux-arm64"),
    ("darwin", "arm64", "node-v16.14.0-darwin-arm64"),
    ("darwin", "amd64", "node-v16.14.0-darwin-x64"),
]
NODE_PACKAGE_DEFAULT = "node-v16.14.0-linux-x64"

# Other names of products.
IMAGE_NAMES = {"tics": "tiflash", "monitoring": "tidb-monitor-initializer"}
IMAGE_ALIAS = ("tics", "tiflash")
PACKED_WITH = ("tidb-lightning", "br")
HOTFIX_BUILD_NAME = ("tiflash", "tics")
TAGGED_BY_BRANCH = "monitoring"

# Products packed with their sources.
UNTAGGED_WITH_SOURCE = ["pd", "tidb", "tidb-test"]
ALWAYS_WITH_SOURCE = ["tiem"]
HOTFIX_WITH_SOURCE = ["tidb", "tikv", "pd"]

# Binaries that come and go with versions.
DROPPED_BINARY = ("tidb-lightning", "/tikv-importer", "5.2.0")
BINARIES_FROM = ("dm", "v5.3.0")

# Products of a matrix that depend on the version.
PRERELEASE_NEWER = ("ng-monitoring", "v5.3.0")
PRERELEASE_ARM_BRANCH = "release-5.1"
NIGHTLY_NEWER_BRANCH = "release-5.3"
NIGHTLY_MASTER_PRODUCT = "monitoring"
NIGHTLY_SINGLE_ARCH = "tics"
NIGHTLY_WITHOUT_DEBUG = "ng-monitoring"

# Results of builds as commit states.
COMMIT_STATES = [
    ("ABORTED", "error", "Jenkins job aborted"),
    ("FAILURE", "failure", "Jenkins job failed"),
    ("SUCCESS", "success", "Jenkins job success"),
]
COMMIT_STATE_DEFAULT = ("error", "Jenkins job meets something wrong")

# How a build ends by exception and message.
KILLED_MESSAGE = "script returned exit code 143"
DONE_MESSAGES = ["hasBeenCached", "hasBeenTested"]

# Tasks whose detail page shows their tests.
TEST_TASKS = ["ut-check", "gosec-check"]
LEGACY_TEST_TASKS = ["atom-ut", "atom-gosec"]

# Marks in tags.
PRERELEASE_MARKS = ["nightly", "alpha"]
HOTFIX_MARK = "-202"

# Pre-release products with a debug image, and the second image of one product.
PRERELEASE_DEBUG = ["dumpling", "ticdc", "tidb-binlog", "tidb", "tikv", "pd"]
PRERELEASE_SECOND_IMAGE = ("br", "tidb-lightning")
