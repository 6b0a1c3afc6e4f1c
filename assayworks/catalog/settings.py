"""Configuration audits, access lists and task arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.checks import acl_check, args_check, config_check, config_checks
from assayworks.operators import rules as R

_RULESETS = {
    "storage_encryption": R.STORAGE_ENCRYPTION,
    "storage_security": R.STORAGE_SECURITY,
    "engine": R.ENGINE,
    "scheduler": R.SCHEDULER,
}

# Which event stands for which setting: (event type, parity of the event) -> key.
_KEYS = {
    ("click", 0): "dfs.encrypt.data.transfer",
    ("click", 1): "yarn.intermediate-data-encryption.enable",
    ("view", 0): "dfs.permissions.enabled",
    ("view", 1): "dfs.permissions.superusergroup",
    ("purchase", 0): "hadoop.registry.secure",
    ("purchase", 1): "hadoop.security.authorization",
    ("signup", 0): "spark.network.crypto.enabled",
    ("signup", 1): "spark.io.encryption.enable",
    ("error", 0): "core.fernet_key",
    ("error", 1): "kubernetes.verify_ssl",
}
_KEY = "CASE " + " ".join(
    f"WHEN event_type = '{kind}' AND event_id % 2 = {odd} THEN '{key}'" for (kind, odd), key in _KEYS.items()) + " END"
# '~' stands for a setting that is there but null.
_VALUE = """CASE WHEN value > 60 THEN '~' WHEN value > 12 THEN 'true'
    WHEN event_type = 'view' AND event_id % 2 = 1 THEN 'supergroup'
    WHEN event_type = 'error' AND event_id % 2 = 0 THEN ''
    WHEN event_type = 'error' THEN 'False' ELSE 'false' END"""


def _entries(spark, folder):
    """The latest value of each setting of each system (a user on a day)."""
    return (
        table(spark, folder, "events")
        .selectExpr("concat(user_id, '@', CAST(ts AS DATE)) AS system", f"{_KEY} AS key", f"{_VALUE} AS value", "ts")
        .groupBy("system", "key").agg(F.nullif(F.max_by("value", "ts"), F.lit("~")).alias("value"))
    )


def _systems(spark, folder):
    """All systems of the entries, and one per customer without any setting."""
    events = table(spark, folder, "events").selectExpr("concat(user_id, '@', CAST(ts AS DATE)) AS system")
    return events.unionByName(table(spark, folder, "customer").selectExpr("concat('new-', c_custkey) AS system"))


_ENTRIES_SQL = f"""
    raw AS (SELECT user_id || '@' || CAST(ts AS DATE) AS system, {_KEY} AS key, {_VALUE} AS value, ts FROM events),
    entries AS (SELECT system, key, nullif(max_by(value, ts), '~') AS value FROM raw GROUP BY system, key),
    systems AS (SELECT DISTINCT system FROM raw UNION ALL SELECT 'new-' || c_custkey FROM customer)
"""


# Fixed values, written out here: the SQL must not take its truth from the package.
_RULES_SQL = """rules(ruleset, key, default_value, bad_value, warning, score) AS (VALUES
    ('storage_encryption', 'dfs.encrypt.data.transfer', 'false', 'false', 'In-transit data encryption is disabled', 0.1),
    ('storage_encryption', 'yarn.intermediate-data-encryption.enable', 'false', 'false', 'Intermediate data encryption is disabled', 0.1),
    ('storage_security', 'dfs.permissions.enabled', 'false', 'false', 'FS access control is disabled', 0.1),
    ('storage_security', 'dfs.permissions.superusergroup', 'supergroup', 'supergroup', 'Task is running with default unrestricted permissions', 0.5),
    ('storage_security', 'hadoop.registry.secure', 'false', 'false', 'Registry security is not enabled', 0.5),
    ('storage_security', 'hadoop.security.authorization', 'false', 'false', 'Authentication is disabled', 0.1),
    ('engine', 'spark.network.crypto.enabled', 'false', 'false', 'Network encryption is disabled', 0.1),
    ('engine', 'spark.io.encryption.enable', 'false', 'false', 'IO encryption is disabled', 0.1),
    ('scheduler', 'core.fernet_key', '', '', 'Fernet key is not set', 0.1),
    ('scheduler', 'kubernetes.verify_ssl', 'False', 'False', 'SSL cert. check is disabled', 0.1))"""

_VIOLATIONS_SQL = f"""
    WITH {_ENTRIES_SQL}, {_RULES_SQL},
    present AS (SELECT system, key, value, TRUE AS there FROM entries),
    violations AS (
        SELECT s.system, r.ruleset, r.key, r.warning, r.score
        FROM systems s CROSS JOIN rules r LEFT JOIN present p ON p.system = s.system AND p.key = r.key
        WHERE CASE WHEN p.there THEN p.value ELSE r.default_value END = r.bad_value)
"""


@CATALOG.add(_VIOLATIONS_SQL + "SELECT system, ruleset, key, warning, CAST(score AS DOUBLE) AS score FROM violations")
def config_audit_violations(spark, folder):
    return config_checks(_systems(spark, folder), _entries(spark, folder), _RULESETS).warnings


@CATALOG.add(_VIOLATIONS_SQL + f"""
    SELECT s.system, n.ruleset, CAST(count(v.key) AS BIGINT) AS n_warnings,
           CAST(coalesce(least(min(v.score), 1.0), 1.0) AS DOUBLE) AS score
    FROM systems s CROSS JOIN (VALUES {", ".join(f"('{name}')" for name in _RULESETS)}) AS n(ruleset)
    LEFT JOIN violations v ON v.system = s.system AND v.ruleset = n.ruleset
    GROUP BY s.system, n.ruleset
""")
def config_audit_score(spark, folder):
    return config_checks(_systems(spark, folder), _entries(spark, folder), _RULESETS).results


def _score_sql(ruleset: str) -> str:
    return _VIOLATIONS_SQL + f"""
        SELECT s.system, CAST(count(v.key) AS BIGINT) AS n_warnings,
               CAST(coalesce(least(min(v.score), 1.0), 1.0) AS DOUBLE) AS score
        FROM systems s LEFT JOIN violations v ON v.system = s.system AND v.ruleset = '{ruleset}'
        GROUP BY s.system
    """


def _score(spark, folder, ruleset):
    return config_check(_systems(spark, folder), _entries(spark, folder), _RULESETS[ruleset]).results


@CATALOG.add(_score_sql("storage_encryption"))
def config_audit_score_storage_encryption(spark, folder):
    return _score(spark, folder, "storage_encryption")


@CATALOG.add(_score_sql("storage_security"))
def config_audit_score_storage_security(spark, folder):
    return _score(spark, folder, "storage_security")


@CATALOG.add(_score_sql("engine"))
def config_audit_score_engine(spark, folder):
    return _score(spark, folder, "engine")


@CATALOG.add(_score_sql("scheduler"))
def config_audit_score_scheduler(spark, folder):
    return _score(spark, folder, "scheduler")


# Access lists: every customer is an object with three roles.
_PERMS = "CASE (c_custkey * 7 + i) % 5 WHEN 0 THEN 'can_read' WHEN 1 THEN 'can_read,can_edit' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'can_edit,can_read' END"
_WANT = "CASE (c_custkey * 3 + i) % 4 WHEN 0 THEN 'can_read' WHEN 1 THEN 'can_edit,can_read' WHEN 2 THEN '' ELSE NULL END"


def _acl(spark, folder, perms, where="true"):
    return (
        table(spark, folder, "customer").selectExpr("*", "explode(sequence(0, 2)) AS i")
        .where(where)
        .selectExpr("concat('dag_', c_custkey) AS object", "concat('role_', (c_nationkey + i) % 25) AS role",
                    f"{perms} AS text")
        .selectExpr("object", "role", "CASE WHEN text = '' THEN array() ELSE split(text, ',') END AS perms")
    )


# Some roles are not expected at all.
_EXPECTED = "(c_custkey + i) % 3 <> 0"

_ACL_SQL = f"""
    WITH roles AS (
        SELECT c_custkey, i, 'dag_' || c_custkey AS object, 'role_' || ((c_nationkey + i) % 25) AS role,
               {_PERMS} AS have, CASE WHEN {_EXPECTED} THEN {_WANT} END AS want
        FROM customer, range(3) AS r(i)),
    lists AS (
        SELECT object, role,
               list_sort(list_filter(string_split(coalesce(have, ''), ','), lambda x: x <> '')) AS have,
               list_sort(list_filter(string_split(coalesce(want, ''), ','), lambda x: x <> '')) AS want
        FROM roles),
    found AS (
        SELECT object, role, 'Unexpected (' || role || ',[' || array_to_string(have, ', ') || '])' AS warning
        FROM lists WHERE have <> want)
"""


def _acl_outcome(spark, folder):
    objects = table(spark, folder, "customer").selectExpr("concat('dag_', c_custkey) AS object")
    return acl_check(objects, _acl(spark, folder, _PERMS), _acl(spark, folder, _WANT, _EXPECTED))


@CATALOG.add(_ACL_SQL + "SELECT object, role, warning FROM found")
def acl_diff(spark, folder):
    return _acl_outcome(spark, folder).warnings


@CATALOG.add(_ACL_SQL + """
    SELECT 'dag_' || c_custkey AS object, CAST(count(f.role) AS BIGINT) AS n_warnings,
           CASE WHEN count(f.role) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM customer LEFT JOIN found f ON f.object = 'dag_' || c_custkey GROUP BY ALL
""")
def acl_score(spark, folder):
    return _acl_outcome(spark, folder).results


# Task arguments: every order is a task with two arguments.
_HAVE_ARGS = """
    SELECT 'task_' || o_orderkey AS task, 'application' AS arg, 'job_' || o_orderstatus || '.py' AS value FROM orders
    UNION ALL
    SELECT 'task_' || o_orderkey, 'args', nullif(o_orderpriority, '5-LOW') FROM orders
"""
_WANT_ARGS = """
    SELECT 'task_' || o_orderkey AS task, 'application' AS arg,
           CASE o_custkey % 2 WHEN 0 THEN 'job_F.py' ELSE 'job_' || o_orderstatus || '.py' END AS value
    FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL
    SELECT 'task_' || o_orderkey, 'args', CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderpriority END
    FROM orders WHERE o_orderkey % 5 <> 0
"""


def _args_outcome(spark, folder):
    orders = table(spark, folder, "orders")
    task = F.concat(F.lit("task_"), F.col("o_orderkey")).alias("task")
    pairs = lambda app, value: F.explode(F.array(
        F.struct(F.lit("application").alias("arg"), app.alias("value")),
        F.struct(F.lit("args").alias("arg"), value.alias("value")))).alias("pair")
    own = F.concat(F.lit("job_"), F.col("o_orderstatus"), F.lit(".py"))
    have = orders.select(task, pairs(own, F.expr("nullif(o_orderpriority, '5-LOW')"))).select("task", "pair.*")
    want = (
        orders.select(
            "o_orderkey", task,
            pairs(F.when(F.col("o_custkey") % 2 == 0, F.lit("job_F.py")).otherwise(own),
                  F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderpriority END")))
        .where("(pair.arg = 'application' AND o_orderkey % 4 <> 0) OR (pair.arg = 'args' AND o_orderkey % 5 <> 0)")
        .select("task", "pair.*")
    )
    return args_check(orders.select(task), have, want)


_ARGS_SQL = f"""
    WITH have AS ({_HAVE_ARGS}), want AS ({_WANT_ARGS}),
    found AS (
        SELECT DISTINCT h.task, h.arg, 'Unexpected arg ' || h.arg || ' with value ' || coalesce(h.value, 'None') AS warning
        FROM have h LEFT JOIN (SELECT *, TRUE AS listed FROM want) w ON w.task = h.task AND w.arg = h.arg
        WHERE w.listed IS NULL OR h.value IS DISTINCT FROM w.value)
"""


@CATALOG.add(_ARGS_SQL + "SELECT task, arg, warning FROM found")
def args_diff(spark, folder):
    return _args_outcome(spark, folder).warnings


@CATALOG.add(_ARGS_SQL + """
    SELECT 'task_' || o_orderkey AS task, CAST(count(f.arg) AS BIGINT) AS n_warnings,
           CASE WHEN count(f.arg) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM orders LEFT JOIN found f ON f.task = 'task_' || o_orderkey GROUP BY ALL
""")
def binary_check_score(spark, folder):
    return _args_outcome(spark, folder).results


# Rules kept as rows, one per nation; a customer is a system whose orders set keys again and again.
_RULE_TABLE_SQL = """
    WITH rules AS (
        SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'off' ELSE 'on' END AS default_value,
               'off' AS bad_value, n_name || ' is off' AS warning, (n_nationkey % 9 + 1) / 10.0 AS score FROM nation),
    entries AS (
        SELECT o_custkey AS system, 'k' || (o_orderkey % 30) AS key,
               max_by(CASE WHEN o_orderstatus = 'O' THEN 'off' ELSE 'on' END, o_orderkey) AS value FROM orders GROUP BY ALL),
    hits AS (
        SELECT c_custkey AS system, r.key, r.warning, r.score
        FROM customer CROSS JOIN rules r LEFT JOIN entries e ON e.system = c_custkey AND e.key = r.key
        WHERE coalesce(e.value, r.default_value) = r.bad_value)
"""


def _rule_table(spark, folder):
    rules = table(spark, folder, "nation").selectExpr(
        "concat('k', n_nationkey) AS key", "CASE WHEN n_nationkey % 2 = 0 THEN 'off' ELSE 'on' END AS default_value",
        "'off' AS bad_value", "concat(n_name, ' is off') AS warning", "CAST((n_nationkey % 9 + 1) / 10 AS DOUBLE) AS score")
    # The last value of a key counts.
    entries = table(spark, folder, "orders").selectExpr(
        "o_custkey AS system", "concat('k', o_orderkey % 30) AS key", "CASE WHEN o_orderstatus = 'O' THEN 'off' ELSE 'on' END AS value",
        "o_orderkey AS position")
    systems = table(spark, folder, "customer").selectExpr("c_custkey AS system")
    return config_check(systems, entries, rules)


@CATALOG.add(_RULE_TABLE_SQL + """
    SELECT c_custkey AS system, count(score) AS n_warnings, CAST(coalesce(min(score), 1.0) AS DOUBLE) AS score
    FROM customer LEFT JOIN hits ON system = c_custkey GROUP BY c_custkey
""")
def config_audit_rule_table(spark, folder):
    return _rule_table(spark, folder).results


@CATALOG.add(_RULE_TABLE_SQL + "SELECT system, key, warning, CAST(score AS DOUBLE) AS score FROM hits")
def config_audit_rule_table_violations(spark, folder):
    return _rule_table(spark, folder).warnings


# As many rules as there are parts, a fifth of them bad by default; each supplier is a system whose
# line items set the keys of their parts, the latest of an order counting.
_MANY_RULES = """SELECT 'part-' || p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'off' ELSE 'on' END AS default_value, 'off' AS bad_value,
    p_name || ' is off' AS warning, CAST((p_size % 50 + 1) AS DOUBLE) / 64 AS score FROM part"""
_MANY_ENTRIES = """SELECT l_suppkey AS system, 'part-' || l_partkey AS key, CASE WHEN l_returnflag = 'R' THEN 'off' WHEN l_returnflag = 'A' THEN 'on' END AS value,
    l_orderkey * 10 + l_linenumber AS position FROM lineitem"""


@CATALOG.add(f"""
    WITH rules AS ({_MANY_RULES}), given AS ({_MANY_ENTRIES}),
    entries AS (SELECT system, key, arg_max(coalesce(value, '~'), (position, coalesce(value = 'off', false))) AS value FROM given GROUP BY ALL),
    hits AS (
        SELECT s_suppkey AS system, r.score FROM supplier CROSS JOIN rules r LEFT JOIN entries e ON e.system = s_suppkey AND e.key = r.key
        WHERE coalesce(e.value, r.default_value) = r.bad_value)
    SELECT s_suppkey AS system, count(score) AS n_warnings, coalesce(min(score), 1.0) AS score
    FROM supplier LEFT JOIN hits ON system = s_suppkey GROUP BY s_suppkey
""")
def config_audit_many_rules(spark, folder):
    for name in ("part", "lineitem"):
        table(spark, folder, name).createOrReplaceTempView(name)
    parts, lines = (spark.sql(sql) for sql in (_MANY_RULES, _MANY_ENTRIES))
    return config_check(table(spark, folder, "supplier").selectExpr("s_suppkey AS system"), lines, parts).results
