"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Poisson count is the sum of counts with a mean of at most this, so no probability underflows.
PART_MEAN = 16.0
#: Terms of the distribution function kept for each part; beyond them less than 2^-52 is left.
TERMS = 96
#: Source tables up to this many rows are sent to all tasks; larger ones are joined, salted.
BROADCAST_SOURCES = 10_000
SALTS = 32


def uniform(name: Column, seed: int, part: Column) -> Column:
    """A number in [0, 1) from a hash of a row's name, the seed and a part number."""
    key = F.concat_ws(":", name, F.lit(str(seed)), part.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """Poisson probabilities summed up, from 0 on."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda a: a["sums"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7,
          total: float | None = None) -> DataFrame:
    """(mix_source, rate): the mean number of times a document of each source is taken.

    A source with share w of the weights gets the rate w * total / rows of the source; ``total``
    is the expected size of the mixture, by default the rows there are. Without ``weights`` a
    source weighs its rows to ``power``. Sources without a weight get the rate 0.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(power)))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "given string, w double")
        weighed = counts.join(given, F.col("mix_source").eqNullSafe(F.col("given")), "left").fillna(0.0, ["w"])
    sums = weighed.agg(F.sum("w"), F.sum("n")).first()
    all_w, all_n = sums[0] or 0.0, sums[1] or 0.0
    share = F.lit(0.0) if all_w == 0 else F.col("w") / F.lit(all_w)
    return weighed.select("mix_source", (share * F.lit(float(all_n if total is None else total)) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7,
                total: float | None = None, seed: int = 0, copy: str | None = "copy") -> DataFrame:
    """Each document as often as its Poisson count says, numbered from 0 in ``copy``, in random order.

    The count inverts a Poisson distribution, whose mean is the rate of the document's source, at a
    number hashed from its id and the seed. So it depends on no other row and on no partitioning;
    rows with equal ids have equal counts. A null source is a source of its own, rows without an id are
    drawn by source and text, and null or empty texts count like others. An empty table stays empty. A
    column named as ``copy`` is replaced (None numbers nothing); all others stay, whatever their names.

    Rows are dealt to partitions by a hash of id and copy and sorted by it there: a global shuffle in
    one exchange, in which a hot source is spread like any other.
    """
    columns = [c for c in docs.columns if c != copy]
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    table = (
        rates(docs, weights, power, total).withColumn("mix_parts", parts)
        .withColumn("mix_sums", _distribution(F.col("rate") / F.col("mix_parts"))).drop("rate")
    )
    # The whole row as one column: no name of the table's meets one of these.
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("mix_row"), F.col("source").alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64("source", "text").cast("string"))).alias("mix_name"))
    if table.count() <= BROADCAST_SOURCES:
        joined = kept.join(F.broadcast(table), kept["source"].eqNullSafe(table["mix_source"]))
    else:
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = kept.withColumn("salt_of_row", F.pmod(F.xxhash64("mix_name"), F.lit(SALTS)).cast("int"))
        joined = kept.join(salted, kept["source"].eqNullSafe(salted["mix_source"]) & (kept["salt_of_row"] == salted["mix_salt"]))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0),
        lambda n, part: n + F.size(F.filter("mix_sums", lambda s: s <= uniform(F.col("mix_name"), seed, part))))
    copies = (
        joined.withColumn("mix_count", count).where("mix_count > 0")
        .select("mix_row", "mix_name", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)).alias("mix_copy"))
        .withColumn("mix_order", F.xxhash64(F.col("mix_name"), F.col("mix_copy"), F.lit(seed)))
    )
    number = [F.col("mix_copy").alias(copy)] if copy else []
    return copies.repartition("mix_order").sortWithinPartitions("mix_order", "mix_name", "mix_copy").select("mix_row.*", *number)
