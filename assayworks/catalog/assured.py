"""A whole plan of checks, run for every run of every pipeline, published and reported."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.operators.report import task_warnings
from assayworks.operators.rules import STORAGE_ENCRYPTION
from assayworks.plans.assurance import assure, run_checks
from assayworks.plans.registry import Task
from assayworks.schemas import CHECK_RESULTS
from assayworks.session import workspace
from assayworks.sources.sinks import published_results, published_warnings, stage

# A nation is a pipeline, a customer one of its runs, an order a lint message of the run.
_PLAN = [
    Task("urls", "urls", {"subjects": "runs", "texts": "texts"}, {"services": ["known.example"]}),
    Task("args", "args", {"tasks": "runs", "args": "args", "expected": "expected_args"}),
    Task("lint", "lint", {"files": "runs", "findings": "lint"}),
    Task("write", "can_write", {"files": "outputs"}, {"user": "etl", "group": "hadoop"}),
    Task("encryption", "config", {"systems": "runs", "entries": "config"}, {"rules": STORAGE_ENCRYPTION}),
]
_RUN = ["concat('n', c_nationkey) AS pipeline", "CAST(c_custkey AS STRING) AS run_id"]
_LINT = """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'error'
    WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'warning' ELSE 'convention' END"""
_TEXT = """CASE c_custkey % 9 WHEN 0 THEN 'get("https://other.example/a")'
    WHEN 1 THEN concat('get("http://known.example/', c_name, '"); get("http://x.example?", 1)')
    ELSE 'get("https://known.example/b")' END"""
_VALUE = "CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END"
_PERM = "CASE c_custkey % 4 WHEN 0 THEN 755 WHEN 1 THEN 775 WHEN 2 THEN 666 ELSE 0 END"
_OWNER = "CASE WHEN c_custkey % 5 = 0 THEN 'etl' ELSE 'other' END"
_GROUP = "CASE WHEN c_custkey % 7 < 3 THEN 'hadoop' ELSE 'other' END"


def _inputs(spark, folder):
    customer = table(spark, folder, "customer")
    lint = table(spark, folder, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*_RUN, f"{_LINT} AS type")
    evidence = {
        "texts": customer.selectExpr(*_RUN, f"{_TEXT} AS text"),
        "args": customer.selectExpr(*_RUN, "'segment' AS arg", "nullif(c_mktsegment, 'BUILDING') AS value"),
        "expected_args": customer.where("c_custkey % 6 <> 0").selectExpr(
            *_RUN, "'segment' AS arg", "CASE WHEN c_custkey % 8 <> 0 THEN nullif(c_mktsegment, 'BUILDING') END AS value"),
        "lint": lint,
        "outputs": customer.selectExpr(
            *_RUN, "concat('/out/', c_custkey) AS path", f"{_OWNER} AS owner", f"{_GROUP} AS `group`", f"{_PERM} AS perm"),
        # The first setting is absent for a third of the runs.
        "config": customer.where("c_custkey % 3 <> 2").selectExpr(
            *_RUN, "'dfs.encrypt.data.transfer' AS key", f"{_VALUE} AS value").unionByName(
            customer.selectExpr(*_RUN, "'yarn.intermediate-data-encryption.enable' AS key", "'true' AS value")),
    }
    runs = customer.selectExpr(*_RUN, "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' AS TIMESTAMP) AS started_at")
    return runs, evidence


_SCORES_SQL = f"""
    lint AS (
        SELECT o_custkey, max(CASE {_LINT} WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS worst, count(*) AS n
        FROM orders GROUP BY o_custkey),
    scores AS (
        SELECT 'n' || c_nationkey AS pipeline, CAST(c_custkey AS VARCHAR) AS run_id,
            CAST(CASE WHEN c_custkey % 9 IN (0, 1) THEN 0.1 ELSE 1.0 END AS DOUBLE) AS urls,
            CAST(CASE WHEN c_custkey % 6 = 0 THEN 0.0
                      WHEN c_custkey % 8 = 0 AND c_mktsegment <> 'BUILDING' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS args,
            CAST(CASE worst WHEN 3 THEN 0.0 WHEN 2 THEN 0.75 WHEN 1 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS lint,
            CAST(CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END
                 WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 < 3 THEN 1.0 ELSE 0.0 END
                 WHEN 2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS write,
            CAST(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.1 END AS DOUBLE) AS encryption
        FROM customer LEFT JOIN lint ON o_custkey = c_custkey)
"""


@CATALOG.add(f"""
    WITH {_SCORES_SQL}
    SELECT pipeline, run_id, least(urls, args, lint, write, encryption) AS score,
           round(urls * args * lint * write * encryption, 6) AS prod_score, 0 AS n_incomplete
    FROM scores
""")
def assured_runs(spark, folder):
    runs, evidence = _inputs(spark, folder)
    return assure(_PLAN, runs, evidence, workspace(spark, "assured")).select(
        "pipeline", "run_id", "score", F.round("prod_score", 6).alias("prod_score"), "n_incomplete")


@CATALOG.add(f"""
    WITH {_SCORES_SQL},
    kept AS (SELECT 'n' || n_nationkey AS pipeline, n_nationkey / 100.0 AS score FROM nation WHERE n_nationkey % 2 = 0)
    SELECT s.pipeline, run_id, t.task_id, CAST(CASE t.task_id
             WHEN 'urls' THEN s.urls WHEN 'args' THEN s.args WHEN 'write' THEN s.write WHEN 'encryption' THEN s.encryption
             ELSE coalesce(k.score, s.lint) END AS DOUBLE) AS score
    FROM scores s CROSS JOIN (VALUES ('urls'), ('args'), ('lint'), ('write'), ('encryption')) AS t(task_id)
    LEFT JOIN kept k ON k.pipeline = s.pipeline
""")
def assured_runs_keeping_lint(spark, folder):
    # Every second nation has an earlier good lint result, which stands for its new runs.
    runs, evidence = _inputs(spark, folder)
    history = table(spark, folder, "nation").selectExpr(
        "concat('n', n_nationkey) AS pipeline", "'old' AS run_id", "'lint' AS task_id",
        "CAST(7 AS BIGINT) AS n_warnings", "CAST(n_nationkey AS DOUBLE) / 100 AS score",
        "CAST(TIMESTAMP_NTZ '2023-01-01 00:00:00' AS TIMESTAMP) AS started_at",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'success' ELSE 'failed' END AS state")
    return run_checks(_PLAN, runs, evidence, history, ["lint"]).results.select(
        "pipeline", "run_id", "task_id", "score")


@CATALOG.add(f"""
    WITH found AS (
        SELECT 'n' || c_nationkey AS pipeline, CAST(c_custkey AS VARCHAR) AS run_id, {_LINT} AS warning
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 1),
    kept AS (
        SELECT 'n' || c_nationkey AS pipeline, CAST(c_custkey AS VARCHAR) AS run_id, c_nationkey / 100.0 AS score,
               unnest(['old ' || n_name, 'older ' || n_name]) AS warning, c_nationkey + 1 AS times
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 2 = 0),
    counted AS (SELECT pipeline, run_id, warning, count(*) AS times FROM found GROUP BY ALL),
    ran AS (
        SELECT 'n' || c_nationkey AS pipeline, CAST(c_custkey AS VARCHAR) AS run_id,
               CASE max(CASE f.warning WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'convention' THEN 1 ELSE 0 END)
                 WHEN 3 THEN 0.0 WHEN 2 THEN 0.75 WHEN 1 THEN 0.9 ELSE 1.0 END AS score, count(f.warning) AS n
        FROM customer LEFT JOIN found f ON f.run_id = CAST(c_custkey AS VARCHAR) WHERE c_nationkey % 2 = 1 GROUP BY ALL)
    SELECT pipeline, run_id, 'lint' AS task_id, CAST(score AS DOUBLE) AS score, n AS n_warnings, warning, times
    FROM ran LEFT JOIN counted USING (pipeline, run_id)
    UNION ALL SELECT pipeline, run_id, 'lint', CAST(score AS DOUBLE), 2 * times, warning, times FROM kept
""")
def assured_runs_keeping_warnings(spark, folder):
    # Every second nation has an earlier good lint result with two kinds of warnings. A later result
    # than the runs must not be kept.
    runs, evidence = _inputs(spark, folder)
    nation = table(spark, folder, "nation")
    moment = "CAST(TIMESTAMP_NTZ '{}-01-01 00:00:00' AS TIMESTAMP) AS started_at"
    fields = ["concat('n', n_nationkey) AS pipeline", "'lint' AS task_id", "'success' AS state"]
    history = nation.where("n_nationkey % 2 = 0").selectExpr(
        *fields, "'old' AS run_id", "CAST(2 * n_nationkey + 2 AS BIGINT) AS n_warnings", "CAST(n_nationkey AS DOUBLE) / 100 AS score",
        moment.format(2023)).unionByName(nation.selectExpr(
            *fields, "'late' AS run_id", "CAST(7 AS BIGINT) AS n_warnings", "CAST(0.5 AS DOUBLE) AS score", moment.format(2025)))
    warned = nation.selectExpr(
        fields[0], fields[1], "'old' AS run_id", "explode(array(concat('old ', n_name), concat('older ', n_name))) AS warning",
        "CAST(n_nationkey + 1 AS BIGINT) AS times").unionByName(nation.selectExpr(
            fields[0], fields[1], "'late' AS run_id", "'late' AS warning", "CAST(7 AS BIGINT) AS times"))
    place = workspace(spark, "assured")
    assure([t for t in _PLAN if t.task_id == "lint"], runs, evidence, place, history, ["lint"], history_warnings=warned)
    return task_warnings(published_results(spark, place), published_warnings(spark, place))


@CATALOG.add(f"""
    WITH tried AS (
        SELECT c_custkey, 'n' || c_nationkey AS pipeline, CAST(c_custkey AS VARCHAR) AS run_id, {_LINT} AS warning,
               o_orderkey % 2 = 0 AS second
        FROM orders JOIN customer ON o_custkey = c_custkey),
    last AS (SELECT * FROM tried WHERE CASE WHEN c_custkey % 2 = 0 THEN second ELSE NOT second END),
    ran AS (
        SELECT 'n' || c_nationkey AS pipeline, CAST(c.c_custkey AS VARCHAR) AS run_id,
               CASE max(CASE l.warning WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'convention' THEN 1 ELSE 0 END)
                 WHEN 3 THEN 0.0 WHEN 2 THEN 0.75 WHEN 1 THEN 0.9 ELSE 1.0 END AS score, count(l.warning) AS n
        FROM customer c LEFT JOIN last l ON l.c_custkey = c.c_custkey GROUP BY ALL),
    counted AS (SELECT pipeline, run_id, warning, count(*) AS times FROM last GROUP BY ALL)
    SELECT pipeline, run_id, 'lint' AS task_id, CAST(score AS DOUBLE) AS score, n AS n_warnings, warning, times
    FROM ran LEFT JOIN counted USING (pipeline, run_id)
""")
def assured_runs_tried_again(spark, folder):
    # A first attempt at all runs finds the messages of odd orders. A second one, at every second run,
    # finds those of even orders. A third finds all, but dies before its warnings are published.
    runs, evidence = _inputs(spark, folder)
    messages = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))

    def lint(rows):
        return {**evidence, "lint": rows.selectExpr(*_RUN, f"{_LINT} AS type")}

    plan = [t for t in _PLAN if t.task_id == "lint"]
    place = workspace(spark, "assured")
    assure(plan, runs, lint(messages.where("o_orderkey % 2 = 1")), place)
    assure(plan, runs.where("CAST(run_id AS BIGINT) % 2 = 0"), lint(messages.where("o_orderkey % 2 = 0")), place)
    dying = run_checks(plan, runs, lint(messages)).results
    stage(dying, place, "results", CHECK_RESULTS, F.to_date("started_at"), "dying")
    return task_warnings(published_results(spark, place), published_warnings(spark, place))
