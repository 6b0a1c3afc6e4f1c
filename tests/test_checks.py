"""Checks on small tables with the edge cases written out."""

from __future__ import annotations

import itertools

import random

import pytest
from pyspark.sql import functions as F

from assayworks.checks import (
    acl_check, args_check, can_read_check, can_write_check, config_check, config_checks, dependency_check,
    job_log_check, lint_check, permission_check, scan_check)
from assayworks.functions.perms import padded_mode, symbolic_to_octal
from assayworks.operators import rules as R
from assayworks.operators.history import latest_app, last_results, previous_runs, reuse_results
from assayworks.operators.report import fleet_report, incomplete_tasks, report, task_rows


def test_absent_and_null_settings(spark, rows):
    systems = spark.createDataFrame([("off",), ("absent",), ("null",), ("on",), ("twice",)], "system string")
    key, other = "dfs.encrypt.data.transfer", "yarn.intermediate-data-encryption.enable"
    entries = spark.createDataFrame(
        [("off", key, "false"), ("null", key, None), ("on", key, "true"), ("twice", key, "true"), ("twice", key, "false"),
         ("off", "unrelated", "false")] + [(s, other, "true") for s in ("off", "absent", "null", "on", "twice")],
        "system string, key string, value string")
    outcome = config_check(systems, entries, R.STORAGE_ENCRYPTION)
    assert rows(outcome.results) == [
        ("absent", 1, 0.1), ("null", 0, 1.0), ("off", 1, 0.1), ("on", 0, 1.0), ("twice", 1, 0.1)]
    assert {r.warning for r in outcome.warnings.collect()} == {"In-transit data encryption is disabled"}


def test_all_rule_sets_on_an_empty_system(spark):
    systems = spark.createDataFrame([("s",)], "system string")
    entries = spark.createDataFrame([], "system string, key string, value string")
    sets = {"a": R.STORAGE_ENCRYPTION, "b": R.STORAGE_SECURITY, "c": R.ENGINE, "d": R.SCHEDULER}
    for ruleset in sets.values():
        row = config_check(systems, entries, ruleset).results.first()
        assert (row.n_warnings, row.score) == (len(ruleset), 0.1)
    together = {r.ruleset: r.n_warnings for r in config_checks(systems, entries, sets).results.collect()}
    assert together == {name: len(ruleset) for name, ruleset in sets.items()}


def test_many_rules(spark):
    many = [R.Rule(f"k{i}", "x", "x", f"w{i}", 0.5) for i in range(105)]
    systems = spark.createDataFrame([("s",)], "system string")
    entries = spark.createDataFrame([("s", "k0", "y"), ("s", "k100", "y")], "system string, key string, value string")
    assert config_check(systems, entries, many).results.first().n_warnings == len(many) - 2
    with pytest.raises(ValueError):
        R.rule_violations(systems, entries, [])


def test_a_table_of_rules_says_what_a_list_says(spark, rows):
    rng = random.Random(5)
    given = [R.Rule(f"k{rng.randrange(12)}", rng.choice("xy"), rng.choice("xy"), f"w{i % 9}", rng.choice([0.1, 0.5, 0.9])) for i in range(20)]
    table = spark.createDataFrame([tuple(r) for r in given + given[:3]], "key string, default_value string, bad_value string, warning string, score double")
    systems = spark.createDataFrame([(f"s{i}",) for i in range(30)] + [("s1",), ("silent",)], "system string")
    found = [(f"s{rng.randrange(32)}", f"k{rng.randrange(15)}", rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    placed = spark.createDataFrame(found, "system string, key string, value string, position int")
    distinct = list(dict.fromkeys(given))
    for entries in (placed, placed.drop("position"), placed.limit(0)):
        for a, b in zip(config_check(systems, entries, distinct), config_check(systems, entries, table), strict=True):
            assert rows(a) == rows(b.select(a.columns))
    none = config_check(systems, placed, table.limit(0))
    assert {tuple(r)[1:] for r in none.results.collect()} == {(0, 1.0)} and none.warnings.count() == 0


def test_rules_of_any_number(spark):
    """50,000 rules and 1,000,000 entries; the plan meets them in one join and pairs nothing."""
    rules = spark.range(50_000).selectExpr(
        "concat('k', id) key", "if(id % 4 = 0, 'off', 'on') default_value", "'off' bad_value", "concat('w', id) warning", "(id % 997 + 1) / 1000D score")
    entries = spark.range(1_000_000).selectExpr("id % 300 system", "concat('k', id * 7919 % 60000) key", "if(id % 11 = 0, 'off', 'on') value")
    systems = spark.range(301).selectExpr("id system")
    result = config_check(systems, entries, rules).results
    assert "NestedLoop" not in result._jdf.queryExecution().executedPlan().toString()
    keys: dict = {}
    for i in range(1_000_000):
        k = i * 7919 % 60000
        keys.setdefault(i % 300, {}).setdefault(k, []).append(i % 11 == 0)
    for r in result.where("system in (0, 7, 300)").collect():
        mine = keys.get(r.system, {})
        broken = [k for k in range(50_000) if (any(mine[k]) if k in mine else k % 4 == 0)]
        assert (r.n_warnings, r.score) == (len(broken), min((k % 997 + 1) / 1000 for k in broken))


def test_the_last_value_of_a_key_counts(spark, rows):
    rules = [R.Rule("k", "bad", "bad", "w", 0.1)]
    entries = spark.createDataFrame([("a", "k", "bad", 1), ("a", "k", "fine", 2), ("b", "k", "fine", 1), ("b", "k", "bad", 2),
                                     ("c", "k", "bad", 1), ("c", "k", None, 2), ("no subject", "k", "bad", 1)],
                                    "system string, key string, value string, position int")
    systems = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "system string")
    assert rows(config_check(systems, entries, rules).results) == [("a", 0, 1.0), ("b", 1, 0.1), ("c", 0, 1.0), ("d", 1, 0.1)]
    # Without positions any bad value does.
    assert rows(config_check(systems, entries.drop("position"), rules).results) == [
        ("a", 1, 0.1), ("b", 1, 0.1), ("c", 1, 0.1), ("d", 1, 0.1)]


def test_acl_is_one_sided(spark, rows):
    schema = "object string, role string, perms array<string>"
    acl = spark.createDataFrame(
        [("d", "op", ["b", "a", "a"]), ("d", "none", None), ("d", "extra", ["x"]), ("e", "op", ["a"]), ("f", "op", [])], schema)
    expected = spark.createDataFrame([("d", "op", ["a", "b"]), ("d", "missing", ["z"]), ("e", "op", None)], schema)
    objects = spark.createDataFrame([("d",), ("e",), ("f",), ("g",)], "object string")
    outcome = acl_check(objects, acl, expected)
    assert rows(outcome.warnings) == [("d", "extra", "Unexpected (extra,[x])"), ("e", "op", "Unexpected (op,[a])")]
    assert rows(outcome.results) == [("d", 1, 0.0), ("e", 1, 0.0), ("f", 0, 1.0), ("g", 0, 1.0)]


def test_args_null_equals_null_and_absent_violates(spark, rows):
    schema = "task string, arg string, value string"
    args = spark.createDataFrame([("t", "args", None), ("t", "x", "1"), ("u", "args", None), ("u", "args", None), ("v", "a", "1")], schema)
    expected = spark.createDataFrame([("t", "args", None), ("t", "x", "2"), ("v", "a", "1"), ("v", "b", "1")], schema)
    outcome = args_check(args.select("task"), args, expected)
    assert rows(outcome.warnings) == [
        ("t", "x", "Unexpected arg x with value 1"), ("u", "args", "Unexpected arg args with value None")]
    assert rows(outcome.results) == [("t", 1, 0.0), ("u", 1, 0.0), ("v", 0, 1.0)]


def test_access_by_brute_force(spark):
    people = [None, "me", "you"]
    cases = [(f"/{m}{u}{g}", "me", "us", int(f"{m:o}"), u, g)
             for m, u, g in itertools.product(range(512), people, [None, "us", "them"])]
    files = spark.createDataFrame(cases, "path string, owner string, group string, perm int, user string, user_group string")
    for check, digits in ((can_read_check, "4567"), (can_write_check, "2367")):
        scores = {r.path: r.score for r in check(files, F.col("user"), F.col("user_group")).results.collect()}
        for path, owner, group, perm, user, user_group in cases:
            mode = f"{perm:04}"
            ok = ((user == owner and mode[-3] in digits) or (user_group == group and mode[-2] in digits) or mode[-1] in digits)
            assert scores[path] == (1.0 if ok else 0.0)


def test_modes(spark):
    shown = spark.createDataFrame([("rw-r--r--",), ("rwxrwxrwt",), ("rwsr-x--T",), ("---------",)], "m string")
    assert [r[0] for r in shown.select(symbolic_to_octal(F.col("m"))).collect()] == [644, 1777, 5750, 0]
    assert [r[0] for r in shown.select(padded_mode(symbolic_to_octal(F.col("m")))).collect()] == ["0644", "1777", "5750", "0000"]


def test_permission_expectations_add_up(spark, rows):
    files = spark.createDataFrame([("/a", "me", "us", 644), ("/b", None, "us", 600)], "path string, owner string, group string, perm int")
    outcome = permission_check(files, owner="you", perm=644)
    assert rows(outcome.warnings) == [
        ("/a", "Unexpected owner me for /a"), ("/b", "Unexpected owner null for /b"), ("/b", "Unexpected permissions 600 for /b")]
    assert rows(outcome.results) == [("/a", 1, 0.0), ("/b", 2, 0.0)]
    assert rows(permission_check(files).results) == [("/a", 0, 1.0), ("/b", 0, 1.0)]


def test_lint_ladder(spark, rows):
    files = spark.createDataFrame([(f,) for f in "abcdef"], "file_path string")
    findings = spark.createDataFrame(
        [("b", "error"), ("b", "convention"), ("c", "fatal"), ("d", "refactor"), ("d", "info"), ("e", "warning"), ("f", "convention"), ("f", None)],
        "file_path string, type string")
    assert rows(lint_check(files, findings).results) == [
        ("a", 0, 1.0), ("b", 2, 0.0), ("c", 1, 0.0), ("d", 2, 0.75), ("e", 1, 0.75), ("f", 2, 0.9)]


def test_dependency_scores(spark, rows):
    projects = spark.createDataFrame([(p,) for p in ("clean", "unknown", "unrated", "rated", "mixed")], "project string")
    findings = spark.createDataFrame(
        [("unknown", "x", "9"), ("unrated", "a", "1"), ("rated", "b", "2"), ("rated", "b", "2"), ("mixed", "a", "1"), ("mixed", "b", "3")],
        "project string, lib string, advisory_id string")
    db = spark.createDataFrame(
        [("a", "pyup.io-1", "CVE-1"), ("a", "pyup.io-1", None), ("b", "pyup.io-2", "CVE-2"), ("b", "pyup.io-2", "CVE-3"), ("b", "pyup.io-3", "CVE-4")],
        "lib string, advisory_id string, cve string")
    scores = spark.createDataFrame([("CVE-1", None), ("CVE-2", 5.0), ("CVE-3", 7.5), ("CVE-4", 10.0)], "cve string, score double")
    found = {r.project: (r.n_warnings, r.score) for r in dependency_check(projects, findings, db, scores).results.collect()}
    assert found == {"clean": (0, 1.0), "unknown": (1, 0.5), "unrated": (1, 0.5), "rated": (2, 0.25), "mixed": (2, 0.0)}


def scans(spark, *cases):
    return spark.createDataFrame([(f"s{i}", code, text) for i, (code, text) in enumerate(cases)], "scan_id string, returncode int, report string")


def test_scan_scores(spark):
    body = '{"data": {"h": {"vulnerabilities": {"v": {"cvss": 4.0}, "w": {}}}, "clean": {}}}'
    mild = '{"data": {"h": {"vulnerabilities": {"v": {"cvss": 4.0}}}}}'
    cases = scans(
        spark,
        (3, "whatever"),                       # failed
        (0, f"start\n{body}\n{{}}"),           # a vulnerability without severity counts 10
        (0, f"start\n{{}}\n{mild}\n"),         # only the last line has hosts
        (0, f"start\n{mild}\n{body}"),         # the lines between win
        (0, "start\n{}\n{}"),                  # no hosts
        (0, "start\n{\n{}"),                   # unreadable
        (0, None),
    )
    outcome = scan_check(cases)
    found = {r.scan_id: (r.n_warnings, None if r.score is None else round(r.score, 6)) for r in outcome.results.collect()}
    assert found == {"s0": (1, 0.0), "s1": (2, 0.0), "s2": (1, 0.6), "s3": (1, 0.6), "s4": (0, 1.0), "s5": (0, None), "s6": (0, None)}
    hosts = {(r.scan_id, r.host, r.n_vulnerabilities) for r in outcome.warnings.collect()}
    assert hosts == {("s0", None, None), ("s1", "h", 2), ("s1", "clean", 0), ("s2", "h", 1), ("s3", "h", 1)}


def app_jobs(spark):
    data = [
        ("a1", "a", "2024-01-01", "x at K.scala:1"), ("a1", "a", "2024-01-01", "y at K.scala:2"),
        ("a2", "a", "2024-01-02", "x at K.scala:9"), ("a2", "a", "2024-01-02", "z at K.scala:1"),
        ("b1", "b", "2024-01-01", "x at K"), ("c1", "c", "2024-01-01", None),
    ]
    return spark.createDataFrame(data, "app_id string, app_name string, at string, job_name string").withColumn(
        "started_at", F.to_timestamp("at")).drop("at")


def test_job_log(spark, rows):
    expected = spark.createDataFrame([("a", "x at K"), ("a", "y at K"), ("b", "x at K")], "app_name string, job string")
    outcome = job_log_check(app_jobs(spark), expected)
    assert rows(outcome.warnings, "app_id", "warning") == [
        ("a2", "New job z at K not present in previous logs"), ("a2", "Unexpected job z at K")]
    assert rows(outcome.results) == [("a1", "a", 0, 1.0), ("a2", "a", 2, 0.0), ("b1", "b", 0, 1.0), ("c1", "c", 0, 1.0)]


def test_latest_and_previous_application(spark, rows):
    wanted = spark.createDataFrame([("a",), ("zz",)], "app_name string")
    assert rows(latest_app(app_jobs(spark), wanted), "app_name", "app_id", "missing") == [("a", "a2", False), ("zz", None, True)]
    assert rows(previous_runs(app_jobs(spark)), "app_id", "previous_app_id") == [
        ("a1", None), ("a2", "a1"), ("b1", None), ("c1", None)]


def results(spark):
    data = [
        ("p", "r1", "t", 0.5, 1, "success"), ("p", "r2", "t", None, 2, "failed"), ("p", "r3", "t", 0.7, 3, "success"),
        ("p", "r1", "u", 1.0, 1, "success"), ("q", "r1", "t", None, 1, "failed"),
    ]
    return spark.createDataFrame(data, "pipeline string, run_id string, task_id string, score double, day int, state string").withColumn(
        "started_at", F.timestamp_seconds("day")).withColumn("ended_at", F.timestamp_seconds("day")).drop("day")


def test_earlier_results(spark, rows):
    assert rows(last_results(results(spark)), "pipeline", "task_id", "run_id", "last_run_id") == [
        ("p", "t", "r1", None), ("p", "t", "r2", "r1"), ("p", "t", "r3", "r1"), ("p", "u", "r1", None), ("q", "t", "r1", None)]
    requested = spark.createDataFrame(
        [("p", "t", True), ("p", "u", False), ("q", "t", True)], "pipeline string, task_id string, keep_last boolean")
    assert rows(reuse_results(requested, results(spark))) == [
        ("p", "t", "keep", "r3", 0.7), ("p", "u", "run", None, None), ("q", "t", "run", None, None)]


def test_report(spark):
    data = [
        ("p", "full", "a", 0.5, 1), ("p", "full", "b", 0.4, 2), ("p", "full", "other", 0.0, 3),
        ("p", "zero", "a", 0.0, 1), ("p", "zero", "b", 0.4, 2),
        ("p", "retried", "a", 0.1, 1), ("p", "retried", "a", 1.5, 2), ("p", "retried", "b", 1.0, 1),
        ("p", "part", "a", 1.0, 1), ("p", "null", "a", 0.9, 1), ("p", "null", "b", None, 2), ("p", "null", "b", 1.0, 1),
    ]
    scored = spark.createDataFrame(data, "pipeline string, run_id string, task_id string, score double, at int").withColumn(
        "ended_at", F.timestamp_seconds("at")).drop("at")
    declared = spark.createDataFrame([("p", "a"), ("p", "b")], "pipeline string, task_id string")
    expected = {
        "full": (0.4, 0.2, 0), "zero": (0.0, 0.0, 0), "retried": (1.0, 1.5, 0), "part": (None, None, 1), "null": (None, None, 1)}
    for found in (report(scored, ["a", "b"]), fleet_report(scored, declared)):
        assert {r.run_id: (r.score, r.prod_score, r.n_incomplete) for r in found.collect()} == expected
    maps = {r.run_id: r.task_scores for r in report(scored, ["a", "b"]).collect()}
    assert maps["part"] == {"a": 1.0, "b": None}
    assert {(r.run_id, r.task_id) for r in incomplete_tasks(scored, declared).collect()} == {("part", "b"), ("null", "b")}
    assert task_rows(scored, declared).count() == 10


def test_report_of_no_tasks(spark):
    nothing = spark.createDataFrame([], "pipeline string, task_id string")
    for found in (report(results(spark), []), fleet_report(results(spark), nothing)):
        assert {(r.score, r.prod_score, r.n_incomplete) for r in found.collect()} == {(1.0, 1.0, 0)}


def test_entries_of_a_rule_table_are_hashed_not_sorted(spark, rows):
    """What a system and rule hold has a fixed size; equal and missing positions give the bad value its way."""
    rules = spark.createDataFrame([("k", "on", "off", "k is off", 0.5), ("j", "off", "off", "j is off", 0.25)],
                                  "key string, default_value string, bad_value string, warning string, score double")
    entries = spark.createDataFrame(
        [("late", "k", "off", 1), ("late", "k", "on", 2), ("back", "k", "on", 1), ("back", "k", "off", 2), ("tie", "k", "on", 3), ("tie", "k", "off", 3),
         ("blank", "k", "off", None), ("blank", "k", "on", 1), ("bare", "k", "off", None), ("bare", "k", None, None), ("null", "j", None, 1),
         ("twice", "j", "off", 5), ("twice", "j", "off", 5)], "system string, key string, value string, position long")
    outcome = config_check(entries.select("system"), entries, rules)
    assert rows(outcome.warnings, "system", "key") == [
        ("back", "j"), ("back", "k"), ("bare", "j"), ("bare", "k"), ("blank", "j"), ("late", "j"), ("tie", "j"), ("tie", "k"), ("twice", "j")]
    assert rows(outcome.results) == [("back", 2, 0.25), ("bare", 2, 0.25), ("blank", 1, 0.25), ("late", 1, 0.25), ("null", 0, 1.0), ("tie", 2, 0.25), ("twice", 1, 0.25)]
    for found in (outcome.results, outcome.warnings):
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
