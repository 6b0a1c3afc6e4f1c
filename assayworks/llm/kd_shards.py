"""Sharding by k-d tree: weighted medians along the widest metadata dimension.

Only DataFrame functions. Documents become points: one whole number per metadata column, in equal grids,
with a hash in its last digits that spreads ties. The cells of the tree are rows of a table. Every level
finds all its cuts at once from histograms of bytes that zoom in on them, one row per cell being left of
each; what the driver sees is whether cells are left to cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import written
from assayworks.operators.ranges import sum_before
from assayworks.session import discard

#: Steps of a dimension, and of the hash below one step.
GRID, TIES = 1 << 30, 1 << 20
BINS = 2048
#: A cut is near enough when its bin holds less than this share of a shard's bytes.
CUT_SHARE = 0.002
#: Rows numbered by one task, and copies of a row made by one.
SLOT_ROWS, COPY_ROWS = 50_000, 10_000


def _ranked(docs: DataFrame, column: str, number: str) -> DataFrame:
    """A text column as the rank of its value among the values there are, bytewise; nulls stay."""
    values = docs.select(F.col(column).alias("kd_value")).where("kd_value IS NOT NULL").distinct().withColumn("kd_one", F.lit(1))
    ranks = sum_before(values, [("kd_value", True)], "kd_one", number).select("kd_value", F.col(number).cast("double").alias(number))
    return docs.join(ranks, F.col(column) == F.col("kd_value"), "left").drop("kd_value")


def _points(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """doc_id, size, text_crc32 and ``at``, a whole number per dimension; nulls and NaN come first.

    Repeated rows are counted and made again by number, so that their ties do not depend on where
    they were read.
    """
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = [F.col(f"`{d}`").cast("binary" if kinds[d] in ("string", "binary") else "timestamp" if kinds[d] == "date" else kinds[d]).alias(f"kd_from_{i}")
             for i, d in enumerate(dimensions)]
    plain = written(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *named)
        .groupBy("doc_id", "size", "text_crc32", *[f"kd_from_{i}" for i in range(len(named))]).agg(F.count("*").alias("kd_copies")), "kd-plain")
    numbered = plain
    for i, d in enumerate(dimensions):
        if kinds[d] in ("string", "binary"):
            numbered = _ranked(numbered, f"kd_from_{i}", f"kd_{i}")
        else:
            numbered = numbered.withColumn(f"kd_{i}", F.col(f"kd_from_{i}").cast("double"))
    numbered = written(numbered.withColumn(f"kd_{len(dimensions)}", F.log1p(F.col("size").cast("double"))), "kd-numbered")
    names = [f"kd_{i}" for i in range(len(dimensions) + 1)]
    real = {n: F.when(~F.isnan(n), F.col(n)) for n in names}
    span = numbered.agg(*[f(real[n]).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))]).first()
    places = []
    for n in names:
        low, high = span[f"low_{n}"] or 0.0, span[f"high_{n}"] or 0.0
        share = (real[n] - F.lit(low)) / F.lit((high - low) or 1.0)
        places.append(F.coalesce(F.floor(share * F.lit(float(GRID))) + 1, F.lit(0)).cast("long"))
    # A row's copies in parts, so that no task makes all copies of a very common row.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(kd_copies - 1) div {COPY_ROWS}"))).alias("kd_part")
    parts = numbered.select("doc_id", "size", "text_crc32", "kd_copies", F.array(*places).alias("kd_places"), part)
    first = F.col("kd_part") * COPY_ROWS
    last = F.least(F.col("kd_copies"), first + COPY_ROWS) - 1
    copies = parts.repartition("doc_id", "text_crc32", "kd_part").select(
        "doc_id", "size", "text_crc32", "kd_places", F.explode(F.sequence(first, last)).alias("kd_copy"))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "kd_copy"), F.lit(TIES))
    rows = written(copies.select("doc_id", "size", "text_crc32", F.transform("kd_places", lambda p: p * TIES + tie).alias("at"),
        F.lit(0).cast("long").alias("cell")), "kd-points")
    discard(plain)
    discard(numbered)
    return rows


def _cut(rows: DataFrame, cells: DataFrame, dims: int, near: float) -> DataFrame:
    """(cell, first, shards, dimension, cut) for every cell of several shards.

    A cell is cut along its widest dimension where its bytes part as its shards do; of the two
    places around that point the nearer one. Each zoom looks at the bin that holds the point, until that
    holds one place, or at most ``near`` bytes.
    """
    held = rows.join(cells.where("shards > 1"), "cell")
    spans = held.groupBy("cell", "first", "shards").agg(
        F.sum("size").alias("weight"), F.array(*[F.min(F.get("at", F.lit(i))) for i in range(dims)]).alias("lows"),
        F.array(*[F.max(F.get("at", F.lit(i))) for i in range(dims)]).alias("highs"))
    widths = F.transform(F.arrays_zip("lows", "highs"), lambda z: z["highs"] - z["lows"])
    # Of equally wide dimensions the first.
    spans = spans.withColumn("dimension", (F.array_position(widths, F.array_max(widths)) - 1).cast("int"))
    step = F.expr(f"greatest((high - low + {BINS - 1}) div {BINS}, 1)")
    looks = written(spans.select(
        "cell", "first", "shards", "dimension", (F.col("weight") * F.expr("shards div 2") / F.col("shards")).alias("want"),
        F.get("lows", "dimension").alias("low"), (F.get("highs", "dimension") + 1).alias("high"), F.lit(0).cast("long").alias("below"),
        F.lit(None).cast("long").alias("cut")), "kd-looks")
    while not looks.where("cut IS NULL").isEmpty():
        open_cells = looks.where("cut IS NULL").withColumn("step", step)
        placed = rows.select("cell", "size", "at").join(open_cells.select("cell", "dimension", "low", "high", "step"), "cell").withColumn("x", F.get("at", "dimension"))
        bins = placed.where("x >= low AND x < high").groupBy("cell", F.expr("(x - low) div step").alias("bin")).agg(
            F.sum("size").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("w").over(Window.partitionBy("cell").orderBy("bin"))
        summed = bins.join(open_cells.select("cell", "first", "shards", "dimension", "below", "want"), "cell").withColumn("upto", F.col("below") + upto)
        # The first bin that reaches the point; the next look is at what lies in it.
        zoomed = summed.where("upto >= want AND upto - w < want").withColumn("before", F.col("upto") - F.col("w"))
        nearer = F.when(F.expr("want - before < upto - want"), F.col("least")).otherwise(F.col("most") + 1)
        done = (F.col("least") == F.col("most")) | (F.col("w") <= near)
        zoomed = zoomed.select(
            "cell", "first", "shards", "dimension", "want", F.col("least").alias("low"), (F.col("most") + 1).alias("high"),
            F.col("before").cast("long").alias("below"), F.when(done, nearer).alias("cut"))
        closed, last = looks.where("cut IS NOT NULL"), looks
        looks = written(closed.unionByName(zoomed), "kd-looks")
        discard(last)
    return looks.select("cell", "first", "shards", "dimension", "cut")


def _tree(rows: DataFrame, shards: int, dims: int, near: float = 0.0) -> DataFrame:
    """The rows (with cell 0) with ``shard``: every level is a written table of rows with their cells."""
    spark = rows.sparkSession
    cells = spark.range(1).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"))
    left = shards
    while left > 1:
        cuts = _cut(rows, cells, dims, near)
        side = F.get("at", "dimension") >= F.col("cut")
        moved = rows.join(cuts.select("cell", "dimension", "cut"), "cell", "left").withColumn(
            "cell", F.when(F.col("cut").isNull(), F.col("cell") * 2 + 1).otherwise(F.col("cell") * 2 + 1 + side.cast("long")))
        # A cell of one shard goes down as it is; of several, the left half takes the lesser part.
        half = F.expr("shards div 2")
        halves = F.when(F.col("shards") == 1, F.array(F.struct((F.col("cell") * 2 + 1).alias("cell"), F.col("first").alias("first"), F.col("shards").alias("shards")))).otherwise(
            F.array(F.struct((F.col("cell") * 2 + 1).alias("cell"), F.col("first").alias("first"), half.alias("shards")),
                    F.struct((F.col("cell") * 2 + 2).alias("cell"), (F.col("first") + half).alias("first"), (F.col("shards") - half).alias("shards"))))
        below = written(cells.select(F.explode(halves).alias("c")).select("c.*"), "kd-cells")
        down = written(moved.drop("dimension", "cut"), "kd-rows")
        for old in (cells, cuts, *([rows] if left < shards else [])):
            discard(old)
        rows, cells, left = down, below, -(-left // 2)
    return rows.join(cells.select("cell", F.col("first").cast("int").alias("shard")), "cell")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
              dimensions: tuple[str, ...] = ("lang", "source", "doc_id")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Cells are split until each leaf is one shard: a cell of k shards gives floor(k/2)/k of its bytes
    to the left. ``shards`` is the number of leaves, or else the bytes there are by ``target_bytes``.
    Dimensions are the named columns and the length of the text; the widest one of a cell, on the
    grid, is split at the weighted median.

    size is the text's UTF-8 bytes (none for null) plus 16. The law is bytes: shards differ by about
    a document and a few thousandths of a shard, so equal texts may part. slot numbers the rows of
    a shard without gaps, and grown_shard is null. Text metadata counts by the order of its values,
    nulls come first, ties and repeated rows are spread by hash, an empty table gives no rows.
    """
    names = [d for d in dimensions if d in docs.columns]
    points = _points(docs, names)
    total, rows = points.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1)))
    buckets = max(8, -(-rows // (shards * SLOT_ROWS)))
    placed = written(_tree(points, shards, len(names) + 1, CUT_SHARE * total / shards).select(
        "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", "at"), F.lit(buckets)).alias("bucket")), "kd-placed")
    before = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    )
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(order)).join(before, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
