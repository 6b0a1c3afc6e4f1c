"""Readers and writers on small hand-made files."""

from __future__ import annotations

import gzip
import json
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from assayworks.checks import config_check
from assayworks.operators.cost import scenario_cost
from assayworks.operators.frames import drop_incomplete, null_to_text, seconds_between
from assayworks.operators.rules import ENGINE, SCHEDULER
from assayworks.schemas import PASSENGERS_CSV
from assayworks.session import workspace
from assayworks.functions.text import quoted_locations, urls_in_code
from assayworks.operators import differences
from assayworks.sources.eventlogs import load_event_logs, stored_jobs
from assayworks.catalog import scans
from assayworks.sources import eventlogs, files, sinks


def write(path, text, newline=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline=newline) as file:
        file.write(text)
    return str(path)


def test_csv_with_quotes_and_gaps(spark, tmp_path):
    path = write(tmp_path / "people.csv", """PassengerId,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked
1,3,"Doe, Dr. Ann",female,51.5,0,0,4711,8.5,,Q
2,1,"Roe, ""Bo"" Lee",male,,1,0,X/1 1,7,Z9,S
3,2,"Poe",male,40,0,0,815,9.25,Z1,Q
""")
    people = files.read_csv(spark, path, PASSENGERS_CSV)
    assert people.schema == PASSENGERS_CSV
    assert people.where("PassengerId = 2").first().Name == 'Roe, "Bo" Lee'
    assert drop_incomplete(people).count() == 1
    assert drop_incomplete(null_to_text(people, "Cabin")).count() == 2
    assert null_to_text(people, "Cabin").where("Cabin = 'None'").count() == 1
    assert dict(files.read_csv(spark, path).dtypes)["Age"] == "double"


def test_requirements(spark, tmp_path, rows):
    path = write(tmp_path / "requirements.txt", "a-b.c==1.0\n\n# only==9\nnumpy==1.22.3 # why\n  x == 2 \nfree>=1\n")
    assert rows(files.read_requirements(spark, path), "lib", "version") == [("a-b.c", "1.0"), ("free", None), ("numpy", "1.22.3"), ("x", "2")]


INI = """# Licensed
#
[core]
# The folder
dags_folder = /opt/dags

fernet_key =
list = a,
    b,
    c
# indented value above
url: http://x:80/?a=b

[kubernetes]
verify_ssl = True
sql_alchemy_conn = sqlite:///x
; off = 1
"""


def test_ini(spark, tmp_path, rows):
    for name, newline in (("unix", "\n"), ("dos", "\r\n")):
        path = write(tmp_path / name / "x.cfg", INI, newline)
        assert rows(files.read_ini(spark, path), "key", "value") == [
            ("core.dags_folder", "/opt/dags"), ("core.fernet_key", ""), ("core.list", "a,\nb,\nc"),
            ("core.url", "http://x:80/?a=b"), ("kubernetes.sql_alchemy_conn", "<redacted>"), ("kubernetes.verify_ssl", "True")]
    entries = files.read_ini(spark, path).withColumnRenamed("path", "system")
    assert config_check(entries.select("system"), entries, SCHEDULER).results.first().score == 0.1
    assert ("kubernetes.sql_alchemy_conn", "sqlite:///x") in rows(files.read_ini(spark, path, redact=False), "key", "value")


def test_hadoop_xml_null_and_empty(spark, tmp_path, rows):
    path = write(tmp_path / "core.xml", """<?xml version="1.0"?><configuration>
<property><name>a</name><value>false</value><final>true</final><source>x</source></property>
<property><name>b</name><value></value></property><property><name>c</name></property></configuration>""")
    assert rows(files.read_hadoop_xml(spark, path), "key", "value") == [("a", "false"), ("b", None), ("c", None)]


def event_lines(app, jobs, properties=None):
    lines = [{"Event": "SparkListenerLogStart", "Spark Version": "4"},
             {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": properties or {}},
             {"Event": "SparkListenerApplicationStart", "App Name": app, "App ID": f"{app}-1", "Timestamp": 1000, "User": "u"}]
    for number, names in enumerate(jobs):
        lines.append({"Event": "SparkListenerJobStart", "Job ID": number, "Stage Infos": [
            {"Stage ID": 10 * number + i, "Stage Name": name, "Number of Tasks": 1} for i, name in enumerate(names)]})
    return [json.dumps(line) for line in lines]


def test_event_logs_single_and_rolling(spark, tmp_path, rows):
    write(tmp_path / "logs" / "app-1", "\n".join(event_lines("one", [["map at A.scala:1", "collect at A.scala:2"]])))
    write(tmp_path / "logs" / "app-2", "\n".join(event_lines("idle", [])))
    rolling = event_lines("rolled", [["a at B"], ["b at B"]], {"spark.network.crypto.enabled": "true"})
    write(tmp_path / "logs" / "eventlog_v2_app-3" / "events_1_app-3", "\n".join(rolling[:4]))
    write(tmp_path / "logs" / "eventlog_v2_app-3" / "events_2_app-3", "\n".join(rolling[4:]))
    path = str(tmp_path / "logs")
    assert rows(files.read_event_log(spark, path), "app_id", "app_name", "job_id", "job_name") == [
        ("idle-1", "idle", None, None), ("one-1", "one", 0, "collect at A.scala:2"),
        ("rolled-1", "rolled", 0, "a at B"), ("rolled-1", "rolled", 1, "b at B")]
    conf = files.read_spark_conf(spark, path)
    assert rows(conf, "key", "value") == [("spark.network.crypto.enabled", "true")]
    entries = conf.withColumnRenamed("path", "system")
    assert config_check(entries.select("system"), entries, ENGINE).results.first().n_warnings == 1


def test_task_log(spark, tmp_path, rows):
    path = write(tmp_path / "runs.yaml", """- dag_id: d
  end_date: '2030-01-02T03:04:05.500003+00:00'
  execution_date: '2030-01-02T01:00:00.000001+00:00'
  start_date: '2030-01-02T03:03:05.250000+00:00'
  state: success
  task_id: pipeline.train
- task_id: checks.network_traffick_check
  dag_id: d
  start_date: '2022-04-20T15:00:00.000001+02:00'
  end_date:
  state: removed
""")
    log = files.read_task_log(spark, path).withColumn("seconds", seconds_between(F.col("start_date"), F.col("end_date")))
    assert rows(log, "task_id", "state", "seconds") == [
        ("checks.network_traffic_check", "removed", None), ("pipeline.train", "success", 60.250003)]
    assert log.where("state = 'removed'").select(F.unix_micros("start_date")).first()[0] % 3_600_000_000 == 1


def test_listing(spark, tmp_path, rows):
    path = write(tmp_path / "ls.txt", """Found 2 items
drwxrwxrwt   - hdfs supergroup          0 2022-04-20 13:05 /tmp
-rw-r-----+  3 me   us              12345 2022-04-20 13:05 /data/a b.csv
""")
    assert rows(files.read_listing(spark, path)) == [("/data/a b.csv", "me", "us", 640), ("/tmp", "hdfs", "supergroup", 1777)]


def test_whole_source_files(spark, tmp_path):
    path = write(tmp_path / "src" / "a.py", "x = 1\r\ny = 'a/b'\n", "")
    write(tmp_path / "src" / "b.py", "")
    found = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_source_files(spark, str(tmp_path / "src")).collect()}
    assert found["a.py"] == "x = 1\r\ny = 'a/b'\n"
    assert path.endswith("a.py")


TIMINGS = """,dag_id,task_id,Probe type,Execution time (s),CC,PC,EC,NC,IC,Task type
0,d,train,,50.5,True,True,True,True,True,Pipeline
1,d,paths,Task probe,0.25,False,True,False,False,True,Code inspection
2,d,args,Pipeline probe,0.125,True,True,False,False,True,Parameters check
3,d,scan,Service probe,180,False,False,False,False,False,Vulnerability check
4,other,train,,7,True,True,True,True,True,Pipeline
"""


def test_scenario_cost(spark, tmp_path):
    timings = files.read_probe_timings(spark, write(tmp_path / "data.csv", TIMINGS))
    cost = {r.scenario: tuple(r)[1:] for r in scenario_cost(timings.where("dag_id = 'd'")).collect()}
    assert cost == {
        "CC": (50.5, 0.0, 0.125, 0.0, 0.0), "PC": (50.5, 0.0, 0.125, 0.0, 0.25), "EC": (50.5, 0.0, 0.0, 0.0, 0.0),
        "IC": (50.5, 0.0, 0.125, 0.0, 0.25), "NC": (50.5, 0.0, 0.0, 0.0, 0.0)}
    assert scenario_cost(timings, keys=["dag_id"]).count() == 10


def test_published_results_append(spark, tmp_path):
    results = spark.createDataFrame([("p", "r", "t", 1, 0.5, "success")], "pipeline string, run_id string, task_id string, n_warnings long, score double, state string").withColumn(
        "started_at", F.timestamp_seconds(F.lit(1))).withColumn("ended_at", F.timestamp_seconds(F.lit(2)))
    warnings = spark.createDataFrame([("p", "r", "t", "w", 1)], "pipeline string, run_id string, task_id string, warning string, times long")
    for _ in range(2):
        sinks.publish(results, warnings, results, str(tmp_path))
    assert sinks.published_results(spark, str(tmp_path)).count() == 2
    assert sinks.published_warnings(spark, str(tmp_path)).first().warning == "w"


def test_workspace_uses_the_shared_folder(spark):
    shared = workspace(spark, "x")
    assert shared.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/")
    assert shared != workspace(spark, "x")


def test_a_store_parses_each_log_once(spark, tmp_path, rows):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    assert stored_jobs(spark, store).count() == 0 and eventlogs.stored_conf(spark, store).count() == 0
    write(logs / "app 1", "\n".join(event_lines("one", [["a at B"]], {"k": "v"})))
    grown = event_lines("two", [["a at B"], ["b at B"]], {"k": "w"})
    write(logs / "eventlog_v2_app-2" / "events_1_app-2", "\n".join(grown[:4]))
    found = lambda: rows(stored_jobs(spark, store), "app_id", "job_id", "job_name", "spark_version")
    assert load_event_logs(spark, str(logs), store) == 2 and load_event_logs(spark, str(logs), store) == 0
    first = [("one-1", 0, "a at B", "4"), ("two-1", 0, "a at B", "4")]
    assert found() == first
    # A load that died left events without its logs' names.
    left = spark.read.parquet(f"{store}/events").withColumn("load", F.lit("dead"))
    left.write.mode("append").partitionBy("kind").parquet(f"{store}/events")
    assert found() == first
    # A log that has grown is parsed again, whole; the others are not.
    write(logs / "eventlog_v2_app-2" / "events_2_app-2", "\n".join(grown[4:]))
    assert load_event_logs(spark, str(logs), store) == 2
    assert found() == [*first, ("two-1", 1, "b at B", "4")]
    assert rows(eventlogs.stored_conf(spark, store), "key", "value") == [("k", "v"), ("k", "w")]
    plan = stored_jobs(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan and "conf" not in plan


def test_rows_and_rejects_add_up(spark, tmp_path):
    listing = write(tmp_path / "ls", "Found 3 items\n/a:\n\n-rw-r--r--   3 o g 42 2022-04-20 13:05 /a/b c\ndrwx 3 o g\ntotal 8\njunk")
    ini = write(tmp_path / "x.cfg", "# top\nstray = 1\n[a]\nk = v\nno value\n\n; c\nx: y\n  more\n[empty]\n[b]\nmy_token here\n=v")
    tasks = write(tmp_path / "t.yaml", "- dag_id: d\n  task_id: t\n  start_date: '2022-04-20T13:05:00+00:00'\n  end_date: null\n- dag_id: d\n- task_id: u\n  end_date: '2022-99-01'\n")
    expected = {
        "listing": (files.parse_listing(spark, listing), 1, {("drwx 3 o g", "no line of a listing"), ("junk", "no line of a listing")}),
        "ini": (files.parse_ini(spark, ini), 2, {("stray = 1", "in no section"), ("no value", "no key and value"),
                                                 ("<redacted>", "no key and value"), ("=v", "no key and value")}),
        "tasks": (files.parse_task_log(spark, tasks), 1, {("dag_id: d", "no task_id"), ("task_id: u\n  end_date: '2022-99-01'\n", "end_date is no date")}),
    }
    for name, (parsed, n, rejects) in expected.items():
        assert {(r.record, r.reason) for r in parsed.rejects.collect()} == rejects, name
        assert all(r.file.startswith("file:") for r in parsed.rejects.collect())
        counts = Observation()
        assert parsed.counted(counts).count() == parsed.rows.count() == n, name
        assert counts.get == {"n_records": n + len(rejects), "n_rejected": len(rejects)}


def test_expected_jobs_by_release(spark, rows):
    jobs = spark.createDataFrame([("a", "x", "j", "3.5"), ("b", "x", "j", "3.4.9"), ("c", "x", "j", None), ("d", "x", "j", "4.0.0-preview1"),
                                  ("e", "x", "j", "10.1"), ("f", "x", "any", None), ("g", "x", "other", "3.5"), ("h", "x", "j", "3.5.0")],
                                 "app_id string, app_name string, job string, spark_version string")
    expected = spark.createDataFrame([("x", "j", "3.5.0", "4.0"), ("x", "j", "10", None), ("x", "any", None, None)],
                                     "app_name string, job string, since string, until string")
    assert [r[0] for r in rows(differences.unexpected_jobs(jobs, expected))] == ["b", "c", "d", "g"]
    assert [r[0] for r in rows(differences.unexpected_jobs(jobs, expected.drop("until")))] == ["b", "c", "g"]
    assert [r[0] for r in rows(differences.unexpected_jobs(jobs, expected.drop("since", "until")))] == ["g"]
    assert [r[0] for r in rows(differences.unexpected_jobs(jobs.drop("spark_version"), expected))] == ["a", "b", "c", "d", "e", "g", "h"]


def test_pieces_of_source_files_hold_what_the_whole_holds(spark, tmp_path):
    """Random texts full of quotes and line ends, cut into splits of a few bytes."""
    rng = random.Random(17)
    parts = ["'", '"', "\n", "\n", " ", "a/b", "x:y", "http://h.org/p", "/", "\r\n", "word", "\x85", "\t", "é"]
    for i in range(6):
        write(tmp_path / "src" / f"f{i}.py", "".join(rng.choice(parts) for _ in range(400)), newline="")
    write(tmp_path / "src" / "quotes.py", "'\n" * 40 + "a/b\n" * 30 + '"\n\n\n  hdfs://x/y \n\n"', newline="")
    write(tmp_path / "src" / "empty.py", "")
    path, setting = str(tmp_path / "src"), "spark.sql.files.maxPartitionBytes"

    def found(texts, take):
        return sorted(map(tuple, texts.select("path", F.explode(take(F.col("text"))).alias("hit")).collect()))

    whole, before = files.read_source_files(spark, path), spark.conf.get(setting)
    want = [found(whole, quoted_locations), found(whole, urls_in_code)]
    assert all(len(w) > 20 for w in want)
    try:
        for size in ("97b", "1000b", "100m"):
            spark.conf.set(setting, size)
            pieces = files.read_source_pieces(spark, path)
            assert [found(pieces, quoted_locations), found(pieces, urls_in_code)] == want
            if size == "97b":
                assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 20
                assert pieces.count() > 2 * whole.count()
    finally:
        spark.conf.set(setting, before)


def _files(folder, name):
    return {d.name: len(list(d.glob("part-*"))) for d in folder.glob(f"{name}=*")}, {p.name[:10] for p in folder.glob(f"{name}=*/part-*")}


def test_sources_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Files are opened one after the other in a task, so one part of a table must not write them all."""
    monkeypatch.setattr(scans, "FOLDERS_A_TASK", 10)
    monkeypatch.setattr(scans, "workspace", lambda spark, label: str(tmp_path / label))
    spark.range(200).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").coalesce(1).write.parquet(str(tmp_path / "tables" / "supplier.parquet"))
    found = scans.scan_source_files(spark, str(tmp_path / "tables")).collect()
    assert sorted(int(r.file) for r in found) == list(range(200))
    files, tasks = _files(tmp_path / "sources", "file")
    assert set(files.values()) == {1} and len(tasks) >= 10


def test_a_log_is_one_file_whatever_parts_its_events_lie_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "FOLDERS_A_TASK", 4)
    monkeypatch.setattr(scans, "workspace", lambda spark, label: str(tmp_path / label))
    spark.range(240).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "id % 30 AS user_id").repartition(6).write.parquet(
        str(tmp_path / "tables" / "events.parquet"))
    path = scans._release_logs(spark, str(tmp_path / "tables"), "true")
    files, tasks = _files(tmp_path / "logs", "eventlog_v2_user")
    assert len(files) == 30 and set(files.values()) == {1} and len(tasks) >= 4
    jobs = eventlogs.read_event_log(spark, path, str(tmp_path / "store"))
    assert jobs.where("job_id IS NOT NULL AND app_id IS NOT NULL").count() == 240


def test_many_small_logs_are_parsed_in_few_tasks(spark, tmp_path):
    """Spark's own packing gives a task 32 files; the store then has a file for each of these tasks and kinds."""
    for i in range(600):
        write(tmp_path / "logs" / f"eventlog_v2_app-{i}" / f"events_1_app-{i}", "\n".join(event_lines(f"a{i}", [["a at B"]])))
    store, settings = str(tmp_path / "store"), ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(s) for s in settings]
    assert load_event_logs(spark, str(tmp_path / "logs"), store) == 600
    assert [spark.conf.get(s) for s in settings] == before
    assert 0 < len(list((tmp_path / "store" / "events" / "kind=job").glob("part-*"))) <= spark.sparkContext.defaultParallelism
    assert stored_jobs(spark, store).where("job_name = 'a at B'").select("app_id").distinct().count() == 600


def test_small_logs_read_whole_give_what_the_line_reader_gives(spark, tmp_path, monkeypatch):
    """Odd lines, names and line ends; only files that are new are opened, and none that is large."""
    lines = event_lines("one", [["a at B"], ["b at \u00e4\u20ac\ufffd"]], {"k": "v", "": "e"})
    job = {"Event": "SparkListenerJobStart", "Job ID": 7, "Stage Infos": [{"Stage ID": 1, "Stage Name": "x at Y"}]}
    odd = [*lines, "", "  ", "{", lines[-1][:20], "null", "7", "[]", json.dumps([job, job]), "  " + json.dumps([job]), json.dumps(job) + " tail",
           json.dumps(job | {"Job ID": "seven"}), json.dumps(job | {"Stage Infos": None}), json.dumps(job | {"Stage Infos": [None]}),
           json.dumps([job | {"Job ID": "seven"}, job]), json.dumps(job | {"Event": None}), json.dumps(job | {"Job ID": 8}).replace("x at Y", "\\u0041 at Y"), "\ufeff" + json.dumps(job)]
    logs = tmp_path / "logs"
    for name, end in (("app-1", "\n"), ("app-2.inprogress", "\r\n"), ("eventlog_v2_app 3/events_1_app 3", "\r")):
        write(logs / name, end.join(odd) + end, newline="")
    write(logs / "app-4.dat", lines[0])
    write(logs / "app-5", "\ufeff" + "\n".join(lines))
    (logs / "app-6.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (logs / "app-7").write_bytes("\n".join(odd).encode().replace(b"x at", b"x \xff\xc3 at"))
    write(logs / "app-8", "")

    def found(whole, path, store):
        monkeypatch.setattr(eventlogs, "WHOLE", whole)
        n = load_event_logs(spark, path, str(tmp_path / store))
        events = spark.read.parquet(str(tmp_path / store / "events"))
        return n, sorted(map(repr, events.drop("load").collect()))

    want = found(-1, str(logs), "lines")
    assert want[0] == 7 and "seven" not in str(want) and len(want[1]) > 60
    assert found(1 << 20, str(logs), "whole") == want
    setting = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(setting)
    size = (logs / "app-1").stat().st_size
    try:
        spark.conf.set(setting, str(size))
        assert size < (logs / "app-2.inprogress").stat().st_size and found(size, str(logs), "both") == want
    finally:
        spark.conf.set(setting, before)
    # A store that has some of the logs takes the others by name.
    found(1 << 20, str(logs / "app-1"), "some")
    assert found(1 << 20, str(logs), "some") == (6, want[1])


def test_rows_of_the_store_move_once_to_meet_their_log(spark, tmp_path):
    """Jobs are shuffled to choose the current loads, and stay there to meet their application."""
    write(tmp_path / "logs" / "app-1", "\n".join(event_lines("one", [["a at B"]])))
    load_event_logs(spark, str(tmp_path / "logs"), str(tmp_path / "store"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = stored_jobs(spark, str(tmp_path / "store"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Two tables of events, and the loads: once grouped for each of them.
    assert plan.count("Exchange hashpartitioning(log") <= 6


def test_logs_are_written_without_files_of_checksums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "workspace", lambda spark, label: str(tmp_path / label))
    spark.range(90).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "nullif(id % 30, 0) AS user_id").write.parquet(str(tmp_path / "tables" / "events.parquet"))
    path = scans._release_logs(spark, str(tmp_path / "tables"), "true")
    assert len(list((tmp_path / "logs").rglob("part-*"))) == 30 and not list((tmp_path / "logs").rglob("*.crc"))
    assert spark.read.text(path).count() == 90 + 30 * 3
