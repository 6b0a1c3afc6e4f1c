"""Readers and writers: evidence files are written from whole tables and read back."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayworks.catalog import CATALOG, table
from assayworks.checks.jobs import stems
from assayworks.functions.text import urls_in_code
from assayworks.ml.prep import widen
from assayworks.operators.differences import unexpected_jobs
from assayworks.operators.frames import seconds_between
from assayworks.plans.standard import expected_jobs
from assayworks.session import workspace
from assayworks.sources import files
from assayworks.sources.eventlogs import load_event_logs, stored_conf, stored_jobs
from assayworks.sources.sinks import read_json, write_json

_NOTE = "concat(o_orderpriority, ', \"', o_orderstatus, '\"')"

_ORDERS_CSV = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("priority", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("is_final", T.BooleanType()),
])


def _order_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"),
        F.expr(_NOTE).alias("note"), (F.col("o_orderstatus") == "F").alias("is_final"))


_ORDERS_SQL = f"""
    SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority,
           {_NOTE} AS note, o_orderstatus = 'F' AS is_final
    FROM orders
"""


@CATALOG.add(_ORDERS_SQL)
def scan_csv(spark, folder):
    path = workspace(spark, "csv")
    _order_rows(spark, folder).write.options(header=True, escape='"').csv(path)
    return files.read_csv(spark, path, _ORDERS_CSV)


@CATALOG.add(_ORDERS_SQL)
def scan_csv_inferred(spark, folder):
    path = workspace(spark, "csv")
    _order_rows(spark, folder).write.options(header=True, escape='"').csv(path)
    return files.read_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@CATALOG.add(_ORDERS_SQL)
def sink_json_roundtrip(spark, folder):
    path = workspace(spark, "json")
    write_json(_order_rows(spark, folder), path)
    return read_json(spark, path, _ORDERS_CSV)


_DIMENSIONS = [f"dim_{i:02d}" for i in range(64)]


@CATALOG.add(
    "SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {name}" for i, name in enumerate(_DIMENSIONS))
    + " FROM embeddings")
def scan_wide(spark, folder):
    path = workspace(spark, "wide")
    wide = widen(table(spark, folder, "embeddings"), "embedding", _DIMENSIONS)
    wide.write.parquet(path)
    return spark.read.parquet(path).select(
        "vec_id", "label", *[F.col(name).cast("double").alias(name) for name in _DIMENSIONS])


@CATALOG.add("""
    SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents
""")
def scan_text(spark, folder):
    path = workspace(spark, "text")
    separator = "\x1e"
    (table(spark, folder, "documents")
     .select("source", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value"))
     .write.partitionBy("source").option("lineSep", separator).text(path))
    return files.read_source_records(spark, path, separator).select(
        F.regexp_extract("text", r"\A(\d+)\n", 1).cast("long").alias("doc_id"),
        F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"),
        F.regexp_replace("text", r"\A\d+\n", "").alias("text"),
    ).select("doc_id", "source", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest"))


@CATALOG.add("""
    SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS lib,
           CASE WHEN p_partkey % 8 <> 4 THEN p_size || '.' || (p_partkey % 10) END AS version
    FROM part WHERE p_partkey % 4 <> 2
""")
def scan_requirements(spark, folder):
    # The comment lines (every fourth) hold a requirement that must not be read; every eighth line
    # pins no version.
    path = workspace(spark, "requirements")
    table(spark, folder, "part").selectExpr("""
        CASE WHEN p_partkey % 8 = 4 THEN concat(replace(p_name, ' ', '-'), '-', p_partkey, CASE WHEN p_partkey % 16 = 4 THEN '>=1' ELSE '' END) ELSE
        CASE p_partkey % 4
          WHEN 0 THEN concat(replace(p_name, ' ', '-'), '-', p_partkey, '==', p_size, '.', p_partkey % 10)
          WHEN 1 THEN concat(replace(p_name, ' ', '-'), '-', p_partkey, '==', p_size, '.', p_partkey % 10, ' # ', p_brand)
          WHEN 2 THEN concat('# ', replace(p_name, ' ', '-'), '-', p_partkey, '==', p_size, '\\n')
          ELSE concat('  ', replace(p_name, ' ', '-'), '-', p_partkey, ' == ', p_size, '.', p_partkey % 10)
        END END AS value""").write.text(path)
    return files.read_requirements(spark, path).select("lib", "version")


_BITS = ", ".join(
    f"CASE WHEN c_custkey % 512 & {1 << (8 - i)} <> 0 THEN '{'rwxrwxrwx'[i]}' ELSE '-' END" for i in range(9))


@CATALOG.add("""
    SELECT '/data/' || c_mktsegment || ' x/' || c_name AS path, 'u' || c_nationkey AS owner,
           'g' || (c_custkey % 7) AS "group",
           CAST((c_custkey % 512) // 64 * 100 + (c_custkey % 64) // 8 * 10 + c_custkey % 8 AS INTEGER) AS perm
    FROM customer
""")
def scan_file_perms(spark, folder):
    path = workspace(spark, "listing")
    table(spark, folder, "customer").selectExpr(f"""
        concat(CASE WHEN c_custkey % 3 = 0 THEN 'd' ELSE '-' END, {_BITS},
               '   ', CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '3' END, ' u', c_nationkey, ' g', c_custkey % 7,
               '  ', c_custkey, ' 2022-04-20 13:05 /data/', c_mktsegment, ' x/', c_name) AS value
    """).write.text(path)
    return files.read_listing(spark, path)


@CATALOG.add("""
    SELECT 'dag_' || user_id AS dag_id,
           'checks.' || CASE event_type WHEN 'signup' THEN 'network_traffic_check' ELSE event_type END AS task_id,
           epoch_us(ts) AS start_us,
           CAST(round(value * 100) AS BIGINT) * 10000 / 1e6 AS seconds,
           CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state
    FROM events
""")
def scan_task_log(spark, folder):
    path = workspace(spark, "tasklog")
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    table(spark, folder, "events").withColumn(
        "end", F.expr("ts + make_dt_interval(0, 0, 0, CAST(round(value * 100) AS DECIMAL(18, 0)) / 100)")
    ).select(F.concat(
        F.lit("- dag_id: dag_"), F.col("user_id"),
        F.lit("\n  end_date: '"), F.date_format("end", stamp),
        F.lit("+00:00'\n  execution_date: '"), F.date_format("ts", stamp),
        F.lit("+00:00'\n  start_date: '"), F.date_format("ts", stamp),
        F.lit("+00:00'\n  state: "), F.expr("CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END"),
        F.lit("\n  task_id: checks."),
        F.expr("CASE event_type WHEN 'signup' THEN 'network_traffick_check' ELSE event_type END"),
    ).alias("value")).write.text(path)
    return files.read_task_log(spark, path).select(
        "dag_id", "task_id", F.unix_micros("start_date").alias("start_us"),
        seconds_between(F.col("start_date"), F.col("end_date")).alias("seconds"), "state")


@CATALOG.add("""
    SELECT event_type AS system, 'key.' || event_id AS key,
           CASE WHEN event_id % 7 > 1 THEN props END AS value
    FROM events
""")
def scan_config_xml(spark, folder):
    path = workspace(spark, "xml")
    (table(spark, folder, "events")
     .selectExpr("event_type", "concat('key.', event_id) AS name",
                 "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE props END AS value")
     .write.partitionBy("event_type").format("xml")
     .options(rootTag="configuration", rowTag="property").save(path))
    return files.read_hadoop_xml(spark, path).select(
        F.regexp_extract("path", r"/event_type=([^/]+)/", 1).alias("system"), "key", "value")


@CATALOG.add("""
    WITH lines AS (
        SELECT event_type, user_id, 'value_' || event_id AS key, CAST(event_id % 97 AS VARCHAR) AS value FROM events
        UNION ALL
        SELECT event_type, user_id, 'note_' || event_id, props || chr(10) || 'more' FROM events
        UNION ALL
        SELECT event_type, user_id, 'db_password_' || event_id,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE '<redacted>' END FROM events
    )
    SELECT event_type AS system, 'user_' || user_id || '.' || key AS key, value FROM lines
""")
def scan_config_ini(spark, folder):
    path = workspace(spark, "ini")
    (table(spark, folder, "events")
     .selectExpr("event_type", """concat(
         '[user_', user_id, ']\n; key = comment\nValue_', event_id, ' = ', event_id % 97, '\n\n# x: y\nnote_', event_id,
         ': ', props, '\n    more\nDB_Password_', event_id, ' =', CASE WHEN event_id % 5 = 0 THEN '' ELSE ' pw' END
       ) AS value""")
     .write.partitionBy("event_type").text(path))
    return files.read_ini(spark, path).select(
        F.regexp_extract("path", r"/event_type=([^/]+)/", 1).alias("system"), "key", "value")


@CATALOG.add("""
    SELECT 'log_' || event_type AS app, p.key, p.value
    FROM events, LATERAL (VALUES
        ('spark.app.id', 'app-' || event_id),
        ('spark.io.encryption.enable', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END)) AS p(key, value)
""")
def scan_spark_conf(spark, folder):
    path = workspace(spark, "conf")
    (table(spark, folder, "events").selectExpr(
        "event_type AS eventlog_v2",
        """to_json(named_struct('Event', 'SparkListenerEnvironmentUpdate', 'Spark Properties', map(
             'spark.app.id', concat('app-', event_id),
             'spark.io.encryption.enable', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END))) AS value""")
     .withColumnRenamed("eventlog_v2", "eventlog_v2_app").write.partitionBy("eventlog_v2_app").text(path))
    return files.read_spark_conf(spark, path).select(
        F.concat(F.lit("log_"), F.regexp_extract("path", r"eventlog_v2_app=(.*)$", 1)).alias("app"), "key", "value")


@CATALOG.add("""
    WITH starts AS (SELECT event_type, epoch_us(min(ts)) // 1000 AS started_ms FROM events GROUP BY event_type)
    SELECT 'app-' || event_type AS app_id, event_type AS app_name, started_ms,
           event_id AS job_id, 'collect at Step' || (event_id % 3) || '.scala:' || user_id AS job_name
    FROM events JOIN starts USING (event_type)
""")
def scan_event_log(spark, folder):
    events = table(spark, folder, "events")
    path = workspace(spark, "eventlog")
    # Milliseconds since the epoch, the test tables' time being UTC.
    millis = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', min(ts))"
    starts = events.groupBy("event_type").agg(F.expr(millis).alias("at")).selectExpr(
        "event_type AS eventlog_v2_app",
        """to_json(named_struct('Event', 'SparkListenerApplicationStart', 'App Name', event_type,
             'App ID', concat('app-', event_type), 'Timestamp', at, 'User', 'x')) AS value""")
    jobs = events.selectExpr(
        "event_type AS eventlog_v2_app",
        """to_json(named_struct('Event', 'SparkListenerJobStart', 'Job ID', event_id, 'Stage Infos', array(
             named_struct('Stage ID', event_id * 2 + 1, 'Stage Name',
                          concat('collect at Step', event_id % 3, '.scala:', user_id)),
             named_struct('Stage ID', event_id * 2, 'Stage Name', 'map at Early.scala:1')))) AS value""")
    starts.unionByName(jobs).write.partitionBy("eventlog_v2_app").text(path)
    return files.read_event_log(spark, path).select(
        "app_id", "app_name", F.unix_millis("started_at").alias("started_ms"), "job_id", "job_name")


#: Folders that one task writes: it opens their files one after the other.
FOLDERS_A_TASK = 50


def _by_folder(rows: DataFrame, column: str) -> DataFrame:
    """The rows dealt out for ``partitionBy(column)``: those of a folder to one task, so that it gets one
    file, and so many tasks that each writes a bounded number of folders. Counts the folders when called."""
    folders = rows.agg(F.approx_count_distinct(column)).first()[0]
    return rows.repartition(max(1, math.ceil(folders / FOLDERS_A_TASK)), column)


# A supplier is a source file of two lines, in a folder of its own.
@CATALOG.add("""
    SELECT CAST(s_suppkey AS VARCHAR) AS file, 'name = "' || s_name || '"' || chr(10) || 'key = ' || s_suppkey || chr(10) AS text FROM supplier
""")
def scan_source_files(spark, folder):
    path = workspace(spark, "sources")
    lines = table(spark, folder, "supplier").selectExpr("s_suppkey AS file", "concat('name = \"', s_name, '\"\n', 'key = ', s_suppkey) AS value")
    _by_folder(lines, "file").write.partitionBy("file").text(path)
    return files.read_source_files(spark, path).select(F.regexp_extract("path", r"/file=(\d+)/", 1).alias("file"), "text")


#: Options for many small files that a query writes for itself: on a local file system no file of checksums beside each
#: (every file and folder made there costs a process that sets its mode), and tasks, not the driver, move folders into place.
_SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
            "mapreduce.fileoutputcommitter.algorithm.version": "2"}


# A customer's broken line, one of every five; its record says what it is.
_BROKEN = "c_custkey % 5 = 0"


@CATALOG.add(f"""
    SELECT 'listing' AS reader, 'drwxr-x--- - u ' || c_name AS record, 'no line of a listing' AS reason FROM customer WHERE {_BROKEN}
    UNION ALL SELECT 'ini', 'novalue' || c_custkey, 'no key and value' FROM customer WHERE {_BROKEN}
    UNION ALL SELECT 'ini', 'my_password' || c_custkey, 'in no section' FROM customer WHERE FALSE
    UNION ALL SELECT 'tasks', 'dag_id: d' || c_custkey || chr(10) || '  state: success',
                     'no task_id' FROM customer WHERE {_BROKEN} AND c_custkey % 2 = 0
    UNION ALL SELECT 'tasks', 'task_id: t' || c_custkey || chr(10) || '  start_date: soon',
                     'start_date is no date' FROM customer WHERE {_BROKEN} AND c_custkey % 2 = 1
""")
def scan_rejects(spark, folder):
    """What three readers could not read, with the reason."""
    customer = table(spark, folder, "customer")
    listing, ini, tasks = (workspace(spark, kind) for kind in ("listing", "ini", "tasks"))
    customer.selectExpr(f"""CASE WHEN {_BROKEN} THEN concat('drwxr-x--- - u ', c_name)
        WHEN c_custkey % 5 = 1 THEN concat('Found ', c_custkey, ' items') WHEN c_custkey % 5 = 2 THEN ''
        ELSE concat('-rw-r--r--   3 u g 42 2022-04-20 13:05 /a/', c_name) END AS value""").write.text(listing)
    customer.selectExpr(f"""concat('[s', c_custkey, ']\n', CASE WHEN {_BROKEN} THEN concat('novalue', c_custkey)
        WHEN c_custkey % 5 = 1 THEN '# comment' ELSE concat('key = ', c_custkey) END) AS value""").write.text(ini)
    customer.selectExpr(f"""concat('- ', CASE WHEN {_BROKEN} AND c_custkey % 2 = 0 THEN concat('dag_id: d', c_custkey, '\n  state: success')
        WHEN {_BROKEN} THEN concat('task_id: t', c_custkey, '\n  start_date: soon')
        ELSE concat('task_id: t', c_custkey, '\n  start_date: ''2022-04-20T13:05:00+00:00''') END) AS value""").write.text(tasks)
    parsed = {"listing": files.parse_listing(spark, listing), "ini": files.parse_ini(spark, ini), "tasks": files.parse_task_log(spark, tasks)}
    rejects = [p.rejects.select(F.lit(reader).alias("reader"), F.regexp_replace(F.regexp_replace("record", r"\A- ", ""), r"\n\z", "").alias("record"), "reason")
               for reader, p in parsed.items()]
    return reduce(DataFrame.unionByName, rejects)


# A user is an application whose log names one of three releases; the first twelve jobs are expected, the
# first four before release 3.5 only, the next four from it on.
_JOB_NAMES = ["collectAsMap at ClusteringMetrics", "collectAsMap at KMeans", "collect at ClusteringMetrics", "collect at ClusteringSummary",
              "collect at KMeans", "countByValue at KMeans", "json at NativeMethodAccessorImpl.java:0", "parquet at KMeans",
              "runJob at SparkHadoopWriter", "showString at NativeMethodAccessorImpl.java:0", "sum at KMeans", "takeSample at KMeans",
              "mine at Bitcoin", "collect at Elsewhere"]
_RELEASE = "CASE user_id % 3 WHEN 0 THEN '3.2.1' WHEN 1 THEN '3.5.0' ELSE '4.0.0-preview1' END"


def _release_logs(spark, folder, where):
    """Rolling logs, one folder per user: release, start, properties and jobs."""
    events = table(spark, folder, "events").where(where)
    names = F.array(*[F.lit(n) for n in _JOB_NAMES])
    name = F.get(names, (F.col("event_id") % len(_JOB_NAMES)).cast("int"))
    # Some names end in the file and line they were called from, as in a log.
    name = F.when(name.contains(":"), name).otherwise(F.concat(name, F.lit(".scala:"), F.col("event_id") % 400))
    jobs = events.select("user_id", F.to_json(F.struct(
        F.lit("SparkListenerJobStart").alias("Event"), F.col("event_id").alias("Job ID"),
        F.array(F.struct(F.col("event_id").alias("Stage ID"), name.alias("Stage Name"))).alias("Stage Infos"))).alias("value"))
    heads = events.groupBy("user_id").agg(F.min("ts").alias("ts")).selectExpr("user_id", f"""explode(array(
        to_json(named_struct('Event', 'SparkListenerLogStart', 'Spark Version', {_RELEASE})),
        to_json(named_struct('Event', 'SparkListenerEnvironmentUpdate', 'Spark Properties', map('spark.user', CAST(user_id AS STRING)))),
        to_json(named_struct('Event', 'SparkListenerApplicationStart', 'App Name', 'spark_kmeans', 'App ID', concat('app-', user_id),
                             'Timestamp', unix_millis(CAST(ts AS TIMESTAMP)))))) AS value""")
    path = workspace(spark, "logs")
    logs = _by_folder(heads.unionByName(jobs).withColumnRenamed("user_id", "eventlog_v2_user"), "eventlog_v2_user")
    logs.write.options(**_SCRATCH).partitionBy("eventlog_v2_user").text(path)
    return path


@CATALOG.add(f"""
    WITH jobs AS (
        SELECT DISTINCT user_id, event_id % {len(_JOB_NAMES)} AS i,
               [{", ".join(f"'{n}'" for n in _JOB_NAMES)}][event_id % {len(_JOB_NAMES)} + 1] AS job FROM events)
    SELECT 'app-' || user_id AS app_id, 'spark_kmeans' AS app_name, job, 'Unexpected job ' || job AS warning
    FROM jobs WHERE i >= 12 OR (i < 4 AND user_id % 3 <> 0) OR (i BETWEEN 4 AND 7 AND user_id % 3 = 0)
""")
def unexpected_jobs_by_release(spark, folder):
    expected = expected_jobs(spark, _JOB_NAMES[:4], "spark_kmeans", until="3.5").unionByName(
        expected_jobs(spark, _JOB_NAMES[4:8], "spark_kmeans", since="3.5")).unionByName(
        expected_jobs(spark, _JOB_NAMES[8:12], "spark_kmeans"))
    return unexpected_jobs(stems(files.read_event_log(spark, _release_logs(spark, folder, "true"))), expected)


@CATALOG.add("""
    SELECT 'app-' || user_id AS app_id, count(*) AS n_jobs, CAST(user_id AS VARCHAR) AS property,
           CASE user_id % 3 WHEN 0 THEN '3.2.1' WHEN 1 THEN '3.5.0' ELSE '4.0.0-preview1' END AS spark_version
    FROM events GROUP BY user_id
""")
def scan_event_store(spark, folder):
    """Jobs, properties and releases from one store, loaded in two goes that parse each log once."""
    store = workspace(spark, "store")
    for part in ("user_id % 2 = 0", "user_id % 2 = 1"):
        load_event_logs(spark, _release_logs(spark, folder, part), store)
    conf = stored_conf(spark, store).select(F.concat(F.lit("app-"), "value").alias("app_id"), F.col("value").alias("property"))
    return stored_jobs(spark, store).groupBy("app_id", "spark_version").agg(F.count("job_id").alias("n_jobs")).join(conf, "app_id")


# All pages, each behind a call with its address, one after the other are a few large source files.
@CATALOG.add("""
    SELECT found AS url, count(*) AS times
    FROM (SELECT unnest(regexp_extract_all('load("' || url || '")' || chr(10) || html, 'https?://[!$-_a-z]+')) AS found FROM pages) GROUP BY found
""")
def scan_source_pieces(spark, folder):
    path = workspace(spark, "pages")
    table(spark, folder, "pages").selectExpr("concat('load(\"', url, '\")\n', html) AS value").where("value IS NOT NULL").write.text(path)
    urls = files.read_source_pieces(spark, path).select(F.explode(urls_in_code(F.col("text"))).alias("url"))
    return urls.groupBy("url").agg(F.count("*").alias("times"))
