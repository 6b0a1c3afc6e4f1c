"""Clean-up of training tables, durations, and the cost of assurance."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.operators.cost import CATEGORIES, SCENARIOS, scenario_cost as cost
from assayworks.operators.frames import drop_incomplete, null_to_text, seconds_between


def _gappy(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS priority",
        "CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice END AS price")


@CATALOG.add("""
    SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'None') AS priority,
           CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice END AS price
    FROM orders
""")
def null_to_string(spark, folder):
    return null_to_text(_gappy(spark, folder), "priority")


@CATALOG.add("""
    SELECT o_orderkey, o_orderpriority AS priority, o_totalprice AS price
    FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey % 10 <> 0
""")
def drop_any_null(spark, folder):
    return drop_incomplete(_gappy(spark, folder))


@CATALOG.add("""
    SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'None') AS priority, o_totalprice AS price
    FROM orders WHERE o_custkey % 10 <> 0
""")
def null_to_string_then_drop(spark, folder):
    return drop_incomplete(null_to_text(_gappy(spark, folder), "priority"))


_LENGTH_US = "CAST(round(value * 100) AS BIGINT) * 10000 + event_id % 10000"


@CATALOG.add(f"SELECT event_id, ({_LENGTH_US}) / 1e6 AS seconds FROM events")
def task_durations(spark, folder):
    events = table(spark, folder, "events")
    ended = F.expr(f"ts + make_dt_interval(0, 0, 0, CAST({_LENGTH_US} AS DECIMAL(18, 0)) / 1000000)")
    return events.select("event_id", seconds_between(F.col("ts"), ended).alias("seconds"))


_CATEGORY = (
    "CASE user_id % 5 WHEN 0 THEN NULL "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CATEGORIES[1:], 1)) + " END")
_FLAGS = {"CC": "value > 10", "PC": "value > 30", "EC": "event_id % 2 = 0", "IC": "event_type <> 'error'", "NC": "value > 90"}


def _timings(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_type AS dag_id", f"{_CATEGORY} AS probe_type", "value AS seconds",
        *[f"{test} AS {flag}" for flag, test in _FLAGS.items()])


def _cost_sql(keys: str) -> str:
    """SQL over the same timings; ``keys`` is empty or a column list ending in a comma."""
    columns = ", ".join(
        f"""round(coalesce(sum(CASE WHEN coalesce(probe_type, 'Pipeline') = '{name}'
            THEN CAST(flag AS INTEGER) * seconds END), 0), 4) AS "{name}" """ for name in CATEGORIES)
    flags = " UNION ALL ".join(
        f"SELECT dag_id, '{flag}' AS scenario, probe_type, seconds, {flag} AS flag FROM timings" for flag in SCENARIOS)
    return f"""
        WITH timings AS (
            SELECT event_type AS dag_id, {_CATEGORY} AS probe_type, value AS seconds,
                   {", ".join(f"{test} AS {flag}" for flag, test in _FLAGS.items())}
            FROM events),
        long AS ({flags})
        SELECT {keys} scenario, {columns} FROM long GROUP BY {keys} scenario
    """


def _rounded(df):
    return df.select(*[
        F.round(name, 4).alias(name) if name in CATEGORIES else F.col(name) for name in df.columns])


@CATALOG.add(_cost_sql(""))
def scenario_cost(spark, folder):
    return _rounded(cost(_timings(spark, folder)))


@CATALOG.add(_cost_sql("dag_id,"))
def scenario_cost_by_dag(spark, folder):
    return _rounded(cost(_timings(spark, folder), keys=["dag_id"]))
