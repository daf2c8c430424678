"""Views that give the given tables the shape of build records.

The same text runs in Spark and in DuckDB. ``BINDINGS`` read the given tables,
``DERIVED`` build on them.
"""

BINDINGS = {
    "ci_runs": """
SELECT o_orderkey AS run_id,
       CASE CAST(o_custkey % 9 AS INT) WHEN 0 THEN 'tidb' WHEN 1 THEN 'tikv' WHEN 2 THEN 'pd' WHEN 3 THEN 'br'
            WHEN 4 THEN 'dumpling' WHEN 5 THEN 'ticdc' WHEN 6 THEN 'tidb-binlog' WHEN 7 THEN 'tics'
            ELSE 'tidb-lightning' END AS product,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'refs/heads/master' WHEN 1 THEN 'release-5.0'
            WHEN 2 THEN 'refs/heads/release-5.2' WHEN 3 THEN 'release-5.3' WHEN 4 THEN 'release-6.1'
            ELSE 'hz-poc' END AS ref,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'verify' WHEN '2' THEN 'merge' ELSE 'daily' END AS trigger_event,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'passed' END AS status,
       concat('user', CAST(o_custkey AS STRING)) AS author,
       CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
            WHEN o_orderkey % 4 = 2 THEN concat('user', CAST(o_custkey AS STRING)) ELSE 'bot' END AS trigger_author,
       o_orderdate AS start_ts,
       CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ms
FROM orders
""",
    "ci_attempts": """
SELECT l_orderkey AS run_id, l_linenumber AS task_no,
       CASE l_linenumber WHEN 1 THEN 'build' WHEN 2 THEN 'unit-test' WHEN 3 THEN 'lint' WHEN 4 THEN 'cyclo'
            WHEN 5 THEN 'gosec' WHEN 6 THEN 'common' ELSE 'unknown-type' END AS task_type,
       CASE WHEN l_returnflag = 'R' THEN 'FAILURE' WHEN l_returnflag = 'N' THEN 'SUCCESS'
            WHEN l_linestatus = 'F' THEN 'ABORTED' ELSE 'UNSTABLE' END AS result,
       CAST(l_quantity AS BIGINT) * 60000 AS duration_ms,
       l_shipdate AS start_ts,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate, l_partkey, l_suppkey) AS BIGINT) AS attempt
FROM lineitem
""",
    "plan_status": """
SELECT event_id, user_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS exec_id, ts,
       CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'purchase' THEN 'SKIPPED' WHEN 'error' THEN 'ERROR'
            ELSE 'RUNNING' END AS status
FROM events
""",
    "it_subtasks": """
SELECT conv_id AS run_id, turn AS sub_no,
       CASE role WHEN 'assistant' THEN 'success' WHEN 'user' THEN 'failed' END AS status
FROM conversations
""",
    "test_cases": """
SELECT d.doc_id AS case_id, d.source AS suite, d.lang AS branch, d.n_chars AS time_ms,
       CASE WHEN l.doc_id IS NULL THEN 'skipped' WHEN l.toxic = 1 THEN 'error'
            WHEN l.quality = 0 THEN 'failed' ELSE 'passed' END AS outcome
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "coverage_lines": """
SELECT l_partkey AS file_id, l_suppkey AS package_id, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit
FROM lineitem
""",
    "findings": """
SELECT l_orderkey AS run_id,
       CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'G101' WHEN 1 THEN 'G103' WHEN 2 THEN 'G104' WHEN 3 THEN 'G304'
            ELSE 'G401' END AS rule_id, l_partkey AS file_id
FROM lineitem
""",
    "cyclo_functions": """
SELECT doc_id AS func_id, source AS package, CAST(n_chars % 30 AS BIGINT) AS complexity FROM documents
""",
    "artifacts": """
SELECT p_partkey AS artifact_id,
       CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'tidb' WHEN 1 THEN 'tikv' WHEN 2 THEN 'pd' WHEN 3 THEN 'br'
            WHEN 4 THEN 'dumpling' WHEN 5 THEN 'ticdc' WHEN 6 THEN 'tidb-binlog' WHEN 7 THEN 'tics'
            ELSE 'tidb-lightning' END AS product,
       CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS arch,
       concat('v', CAST(4 + p_size % 3 AS STRING), '.', CAST(p_size % 5 AS STRING), '.0') AS tag,
       substr(concat(md5(p_name), md5(p_brand)), 1, CASE WHEN p_size < 5 THEN 39 ELSE 40 END) AS sha
FROM part
""",
    "vulnerabilities": """
SELECT p_partkey AS vuln_id, p_brand AS image,
       CASE p_type WHEN 'PROMO' THEN 'CRITICAL' WHEN 'ECONOMY' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM part
""",
    "build_errors": """
SELECT event_id,
       CASE event_type WHEN 'click' THEN 'FlowInterruptedException' WHEN 'view' THEN 'InterruptedException'
            WHEN 'error' THEN 'AbortException' WHEN 'purchase' THEN 'Exception' END AS exc_class,
       CASE WHEN event_type = 'purchase' AND value < 50 THEN 'hasBeenCached'
            WHEN event_type = 'error' AND value > 50 THEN 'script returned exit code 143'
            ELSE 'script returned exit code 1' END AS message
FROM events
""",
}

DERIVED = {
    "repo_names": """
SELECT run_id,
       CASE run_id % 5 WHEN 0 THEN concat('acme/', product) WHEN 1 THEN product
            WHEN 2 THEN concat('acme/', product, '/') WHEN 3 THEN concat('acme/forks/', product)
            ELSE concat('/', product) END AS name
FROM ci_runs
""",
    "branches": """
SELECT run_id, product, trigger_event, author, trigger_author, status, start_ts, duration_ms,
       replace(ref, 'refs/heads/', '') AS branch,
       CASE WHEN run_id % 3 = 0 THEN '' WHEN run_id % 3 = 1 THEN concat('v5.', CAST(run_id % 5 AS STRING), '.0')
            ELSE concat('v', CAST(4 + run_id % 8 AS STRING), '.0.', CAST(run_id % 3 AS STRING)) END AS tag
FROM ci_runs
""",
    "task_inputs": """
SELECT run_id, task_no, attempt,
       CASE WHEN duration_ms % 7 = 0 THEN NULL ELSE CAST(duration_ms / 60000 - 3 AS INT) END AS timeout,
       CASE WHEN task_no % 5 = 0 THEN NULL ELSE CAST(run_id % 14 AS INT) END AS retry,
       CASE run_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(CAST(500 + task_no AS STRING), 'm') END AS request_cpu,
       CASE run_id % 4 WHEN 0 THEN NULL ELSE concat(CAST(task_no AS STRING), 'Gi') END AS request_memory,
       CASE run_id % 3 WHEN 0 THEN NULL ELSE concat(CAST(900 + task_no AS STRING), 'm') END AS limit_cpu,
       CASE run_id % 5 WHEN 0 THEN '' ELSE concat(CAST(2 * task_no AS STRING), 'Gi') END AS limit_memory
FROM ci_attempts
""",
    "secrets": """
SELECT p_partkey AS task_id, p_brand AS secret_id, p_type AS key_name,
       CASE p_size % 4 WHEN 0 THEN concat(p_brand, ':', p_type, ',bad,a:b:c,')
            WHEN 1 THEN concat(p_brand, ':', p_type) WHEN 2 THEN ''
            ELSE concat('x:,', p_brand, ':', p_type, ',,y:z') END AS secret_vars
FROM part
""",
    "image_versions": """
SELECT artifact_id, product, arch, tag, sha,
       concat('release-', substr(tag, 2, 3)) AS branch,
       artifact_id % 2 = 0 AS failpoint, artifact_id % 3 = 0 AS debug
FROM artifacts
""",
    "heads": """
SELECT product AS repo, concat('release-', substr(tag, 2, 3)) AS ref, sha, artifact_id AS seen FROM artifacts
""",
    "commit_log": """
SELECT a.product AS repo, o.o_orderdate + INTERVAL 3 DAY AS ts, concat(a.sha, '-', CAST(o.o_orderkey AS STRING)) AS sha,
       o.o_orderkey AS seen
FROM orders o JOIN artifacts a ON o.o_custkey = a.artifact_id
""",
    "outcomes": """
SELECT run_id, product, branch, trigger_event, author, trigger_author, start_ts,
       CASE status WHEN 'failed' THEN 'FAILURE' WHEN 'passed' THEN 'SUCCESS' END AS result,
       CASE run_id % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'IfPipelineFail' END AS policy
FROM branches
""",
    "build_params": """
SELECT run_id, product AS REPO, CASE WHEN run_id % 7 = 0 THEN '' ELSE product END AS PRODUCT,
       CASE WHEN run_id % 11 = 0 THEN NULL ELSE 'amd64' END AS ARCH, 'linux' AS OS,
       CASE WHEN run_id % 13 = 0 THEN '' ELSE author END AS GIT_HASH,
       CASE WHEN run_id % 17 = 0 THEN NULL ELSE 'community' END AS EDITION,
       tag AS RELEASE_TAG, CASE WHEN run_id % 2 = 0 THEN branch END AS TARGET_BRANCH
FROM branches
""",
    "wanted_builds": """
SELECT artifact_id, product, sha AS commit, concat(tag, CASE WHEN artifact_id % 7 = 0 THEN '' ELSE '-nightly' END) AS tag
FROM artifacts WHERE length(sha) = 40
""",
    "found_builds": """
SELECT artifact_id, product, CASE WHEN artifact_id % 11 = 0 THEN NULL ELSE sha END AS commit,
       concat(tag, CASE WHEN artifact_id % 7 = 0 THEN '' WHEN artifact_id % 3 = 0 THEN '-alpha' ELSE '-nightly' END) AS tag
FROM artifacts WHERE tag < 'v6.3.0'
""",
    "receivers": """
SELECT run_id, author, trigger_author, run_id % 3 AS kind FROM branches
""",
}
