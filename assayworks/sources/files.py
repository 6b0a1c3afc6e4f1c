"""Readers: one DataFrame of evidence rows from any number of files.

Every reader is a plain Spark scan with a fixed schema, so many files are read in parallel
and large ones are split. Records that span lines are cut by a record separator instead of
reading files whole; source files are read as whole texts, or in pieces that no match crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayworks.functions.perms import symbolic_to_octal
from assayworks.functions.text import strip
from assayworks.sources.eventlogs import read_event_log, read_spark_conf  # noqa: F401

_FILE = "_metadata.file_path"

# What stands in for a secret, and which sectioned keys are secret.
REDACTED = "<redacted>"
SECRET_KEY = r"(?i)(password|passwd|secret|token|private_key|sql_alchemy_conn|result_backend|broker_url|fernet_key)"


class Parsed:
    """What a reader made of its files: ``rows``, and the records it could not read.

    ``records`` has file, record and ``reason``, which is null for a record that became a row: there
    are as many rows as such records. ``rejects`` are the others.
    """

    def __init__(self, records: DataFrame, made: Callable[[DataFrame], DataFrame]) -> None:
        self.records, self._made = records, made

    @property
    def rows(self) -> DataFrame:
        return self._made(self.records.where(F.col("reason").isNull()))

    @property
    def rejects(self) -> DataFrame:
        return self.records.where(F.col("reason").isNotNull()).select("file", "record", "reason")

    def counted(self, counts: Observation) -> DataFrame:
        """The rows; the first action on them also counts ``n_records`` and ``n_rejected``."""
        seen = self.records.observe(counts, F.count(F.lit(1)).alias("n_records"), F.count("reason").alias("n_rejected"))
        return self._made(seen.where(F.col("reason").isNull()))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
             **options) -> DataFrame:
    """CSV with a header line. Without a schema the types are inferred, at the price of one
    more pass over the files."""
    reader = spark.read.options(header=True, quote='"', escape='"', **options)
    if schema is None:
        return reader.csv(path, inferSchema=True)
    return reader.csv(path, schema=schema, enforceSchema=True)


def read_source_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text): every file as one whole text."""
    return spark.read.text(path, wholetext=True).select(F.col(_FILE).alias("path"), F.col("value").alias("text"))


def read_source_pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text): files of any size in pieces of lines, where no quoted location and no URL is cut.

    What :mod:`~assayworks.functions.text` finds in the pieces of a file is what it finds in the whole:
    only white space beside a quote lets a match go on over a line's end, so files are cut between a
    line that does not end with a quote and one that does not begin with one, neither of them blank.
    Large files are read in many tasks; a window looks at the lines of one split, and one row per split
    tells which piece goes on into the next.
    """
    split = [F.col("path"), F.col("block")]
    lines = spark.read.text(path, lineSep="\n").select(
        F.col(_FILE).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    bare = strip(F.col("value"))
    ends = F.when(bare == "", "\"").otherwise(F.right(bare, F.lit(1)))
    lines = lines.withColumn("begins", F.when(bare == "", "\"").otherwise(F.substring(bare, 1, 1)))
    order = Window.partitionBy(*split).orderBy("line")
    free = ~F.lag(ends).over(order).isin("'", "\"") & ~F.col("begins").isin("'", "\"")
    # The lines before a split's first cut belong to piece 0, which an earlier split may have begun.
    lines = lines.withColumn("cut", F.coalesce(free, F.lit(False)).cast("int")).withColumn("piece", F.sum("cut").over(order))
    last = lines.groupBy(*split).agg(F.max("piece").alias("piece"))
    begun = F.when((F.col("piece") > 0) | (F.col("block") == 0), F.struct("block", "piece"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owners = last.select(*split, F.last(begun, ignorenulls=True).over(before).alias("owner"))
    own = F.when((F.col("piece") == 0) & F.col("owner").isNotNull(), F.col("owner")).otherwise(F.struct("block", "piece"))
    held = lines.join(owners, ["path", "block"]).withColumn("own", own)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")
    return held.groupBy("path", "own").agg(text.alias("text")).select("path", "text")


def read_source_records(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(path, text): many texts per file, parted by a separator that no text contains."""
    return spark.read.text(path, lineSep=separator).select(F.col(_FILE).alias("path"), F.col("value").alias("text"))


def read_requirements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, lib, version): one row per requirement; comments and blank lines drop out.

    ``name==version`` gives both; any other line is passed on with a null version and what names
    it (up to the first comparison, bracket, marker or blank) as lib.
    """
    pinned = r"^([\w.-]+)\s*==\s*(.+)$"
    line = F.trim(F.split(F.col("value"), "#", 2)[0])
    is_pinned = F.col("line").rlike(pinned)
    return (
        spark.read.text(path).select(F.col(_FILE).alias("path"), line.alias("line")).where(F.col("line") != "")
        .select("path", F.when(is_pinned, F.regexp_extract("line", pinned, 1)).otherwise(
                    F.regexp_extract("line", r"^([^\s<>=!~;\[@]*)", 1)).alias("lib"),
                F.when(is_pinned, F.regexp_extract("line", pinned, 2)).alias("version"))
    )


def read_hadoop_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, key, value) from ``<property><name/><value/></property>`` files.

    A missing value element gives null, as an empty one does.
    """
    schema = T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
    return (
        spark.read.format("xml").option("rowTag", "property").schema(schema).load(path)
        .select(F.col(_FILE).alias("path"), F.col("name").alias("key"), F.nullif("value", F.lit("")).alias("value"))
    )


def parse_ini(spark: SparkSession, path: str | Sequence[str], redact: bool = True) -> Parsed:
    """(path, key, value) from sectioned files, keys as ``section.key``, and the lines that are none.

    One record per section, split at the line that opens the next one; then one per entry. Secret
    values are replaced unless they are empty (an empty secret is what the rules look for), in what
    is rejected too. Blank lines, comments and sections without entries are no records.
    """
    record = F.regexp_replace(F.col("value"), r"\r\n", "\n")
    header = r"^\[?([^\]\n]+)\][^\n]*(?:\n|\z)"
    entry = r"^([^=:\s][^=:]*?)\s*[=:]\s*((?s:.*))\z"
    sections = (
        spark.read.text(path, lineSep="\n[").select(F.col(_FILE).alias("file"), record.alias("section"))
        # Text before the first section may hold comments only; cut it off its header.
        .withColumn("section", F.regexp_replace("section", r"\A(?:[ \t]*(?:[#;][^\n]*)?\n)+(?=\[)", ""))
        .withColumn("name", F.when(F.col("section").rlike(header), strip(F.regexp_extract("section", header, 1))))
        .withColumn("body", F.when(F.col("name").isNotNull(), F.regexp_replace("section", header, "")).otherwise(F.col("section")))
        # Full-line comments go away, indented lines continue the value above them.
        .withColumn("body", F.regexp_replace("body", r"(?m)^[ \t]*[#;][^\n]*(?:\n|\z)", ""))
        .select("file", "name", F.explode(F.split("body", r"\n(?![ \t]+\S)")).alias("record"))
        .where(~F.col("record").rlike(r"^\s*$"))
    )
    reason = F.when(F.col("name").isNull(), "in no section").when(~F.col("record").rlike(entry), "no key and value")
    key = F.concat_ws(".", "name", F.lower(strip(F.regexp_extract("record", entry, 1))))
    value = F.regexp_replace(strip(F.regexp_extract("record", entry, 2)), r"\n[ \t]+", "\n")
    if redact:
        value = F.when(key.rlike(SECRET_KEY) & (value != ""), F.lit(REDACTED)).otherwise(value)
    records = sections.withColumn("reason", reason)
    if redact:
        hidden = F.when(F.col("reason").isNotNull() & F.col("record").rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(F.col("record"))
        records = records.withColumn("record", hidden)
    return Parsed(records, lambda good: good.select(F.col("file").alias("path"), key.alias("key"), value.alias("value")))


def read_ini(spark: SparkSession, path: str | Sequence[str], redact: bool = True) -> DataFrame:
    """The rows of :func:`parse_ini`."""
    return parse_ini(spark, path, redact).rows


def read_scans(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, report): the printed output of scanners, one file each."""
    return read_source_files(spark, path).withColumnRenamed("text", "report")


# Lines of a listing that name a folder or count entries.
_HEADING = r"^(?:Found \d+ items?|total \S+|[^\s].*:)$"


def parse_listing(spark: SparkSession, path: str | Sequence[str]) -> Parsed:
    """(path, owner, group, perm) from recursive directory listings, and the lines that are none.

    Lines look like ``-rw-r--r--   3 owner group 42 2022-04-20 13:05 /a/b``; the access mark ``+``
    after the mode is allowed. Blank lines and the headings of folders are no records.
    """
    line = (
        r"^[-dl]([-rwxsStT]{9})[+.]?\s+\S+\s+(\S+)\s+(\S+)\s+\d+\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+(.+)$")
    records = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$") & ~F.col("value").rlike(_HEADING)).select(
        F.col(_FILE).alias("file"), F.col("value").alias("record"), F.when(~F.col("value").rlike(line), "no line of a listing").alias("reason"))
    return Parsed(records, lambda good: good.select(
        F.regexp_extract("record", line, 4).alias("path"),
        F.regexp_extract("record", line, 2).alias("owner"),
        F.regexp_extract("record", line, 3).alias("group"),
        symbolic_to_octal(F.regexp_extract("record", line, 1)).alias("perm")))


def read_listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of :func:`parse_listing`."""
    return parse_listing(spark, path).rows


# Task ids that were spelled differently in the logs.
TASK_ALIASES = {"network_traffick_check": "network_traffic_check"}


def parse_task_log(spark: SparkSession, path: str | Sequence[str]) -> Parsed:
    """(dag_id, task_id, execution_date, start_date, end_date, state) from a YAML list of flat maps,
    whatever the order of the keys, and the records that name no task or hold a date that is none."""
    record = F.concat(F.lit("\n"), F.regexp_replace("record", r"\A- ", ""))
    dates = ("execution_date", "start_date", "end_date")

    def field(name: str) -> Column:
        raw = F.regexp_extract(record, rf"\n\s*{name}:[ \t]*'?([^'\n]*)'?", 1)
        return F.nullif(F.trim(raw), F.lit(""))

    task = field("task_id")
    for spelled, meant in TASK_ALIASES.items():
        task = F.regexp_replace(task, rf"\b{spelled}\b", meant)
    # YAML writes a date that is not there as null or ~.
    unread = [F.when(field(d).isNotNull() & ~field(d).isin("null", "~") & F.try_to_timestamp(field(d)).isNull(), f"{d} is no date") for d in dates]
    records = spark.read.text(path, lineSep="\n- ").select(F.col(_FILE).alias("file"), F.col("value").alias("record")).where(
        ~F.col("record").rlike(r"^\s*(?:-\s*)?$"))
    records = records.withColumn("reason", F.coalesce(F.when(task.isNull(), "no task_id"), *unread))
    return Parsed(records, lambda good: good.select(
        field("dag_id").alias("dag_id"), task.alias("task_id"), *[F.try_to_timestamp(field(d)).alias(d) for d in dates],
        field("state").alias("state")))


def read_task_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of :func:`parse_task_log`."""
    return parse_task_log(spark, path).rows


def read_probe_timings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The probe timing table under short names."""
    from assayworks.schemas import PROBE_TIMINGS_CSV

    return (
        read_csv(spark, path, PROBE_TIMINGS_CSV).drop("row")
        .withColumnsRenamed({"Probe type": "probe_type", "Execution time (s)": "seconds",
                             "Task type": "task_type"})
    )
